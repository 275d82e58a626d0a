"""Phrases that are looked for in lines, word by word.

A phrase is plain text in lower case.  Its words stand in a line with blanks between them; it begins
and ends where words do, unless a star on that side lets letters or figures go on.  ``#`` stands for
a figure.
"""

from __future__ import annotations

from typing import NamedTuple

BLANKS = " \t\n\v\f\r"
DIGITS = "0123456789"

# Wording of summary lines.
SUMMARY = (
    "brought forward*", "carried forward*",
    "opening balance*", "closing balance*", "start balance*", "starting balance*", "end balance*", "ending balance*", "previous balance*", "new balance*", "final balance*",
    "balance on", "balance at", "balance as at", "balance b/f", "balance c/f",
    "total paid*", "total money*", "total payment*", "total receipt*", "total debit*", "total credit*", "total withdrawal*", "total deposit*", "total in", "total out", "total amount*",
    "total:*", "total :*", "totals:*", "totals :*",
)
# Wording of lines that state a balance before the first transaction.
OPENING = ("brought forward*", "b/f*", "opening balance*", "start balance*", "starting balance*", "previous balance*")
# Wording of lines that are no transactions unless they have a date of their own.
NOISE = (
    "*overdraft*", "*interest rate*", "aer", "ear", "apr", "gross", "*sortcode*", "*sort code*", "*account number*", "*account no", "*account name*",
    "iban", "bic", "swift", "*page #*", "fscs", "*compensation scheme*", "*statement period*", "*statement date*", "*statement number*", "*statement no",
    "limit", "*%*", "*protected up to*",
)


def in_word(text: str, at: int) -> bool:
    """Whether a letter, a figure or an underscore stands there."""
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


class Phrase(NamedTuple):
    words: tuple[str, ...]
    begins: bool
    ends: bool

    @classmethod
    def of(cls, text: str) -> Phrase:
        return cls(tuple(text.strip("*").split(" ")), not text.startswith("*"), not text.endswith("*"))

    def end(self, low: str, at: int) -> int:
        """Where the phrase that starts there ends; -1 if it does not."""
        for k, word in enumerate(self.words):
            gap = at
            while k and at < len(low) and low[at] in BLANKS:
                at += 1
            if k and at == gap:
                return -1
            if word == "#":
                if not (at < len(low) and low[at] in DIGITS):
                    return -1
                at += 1
            elif low.startswith(word, at):
                at += len(word)
            else:
                return -1
        return -1 if self.ends and in_word(low, at) else at

    def find(self, low: str) -> tuple[int, int] | None:
        """Where it first stands in a line."""
        at = low.find(self.words[0])
        while at >= 0:
            if not (self.begins and in_word(low, at - 1)):
                stop = self.end(low, at)
                if stop >= 0:
                    return at, stop
            at = low.find(self.words[0], at + 1)
        return None


class Wording:
    """Phrases of one meaning.  ``hints``: pieces of text of which every phrase holds one; lines
    without any are passed over."""

    def __init__(self, phrases: tuple[str, ...], hints: tuple[str, ...]):
        self.phrases, self.hints = tuple(map(Phrase.of, phrases)), hints
        missing = [p for p in phrases if not any(h in p for h in hints)]
        if missing:
            raise ValueError(f"phrases without a hint: {missing}")

    def find(self, low: str) -> tuple[int, int] | None:
        """The first place in a line at which one of the phrases stands."""
        return min((found for p in self.phrases if (found := p.find(low))), default=None)

    def said(self, low: str) -> bool:
        return any(p.find(low) for p in self.phrases)
