"""What the lines of column statements say by themselves, for a whole Arrow batch of lines at once.

The lines of a batch are joined into one text, with a mark between them that no pattern matches, and
each pattern runs over that text once.  What is found is kept as flat arrays of offsets and handed out
as list and struct columns; the line of a find is looked up from its offset.  Places are in characters
of their line.  Lower case means A-Z here, so that places stay what they are.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledger_jobs.functions.dates import FULL_MONTHS, MONTHS
from ledger_jobs.functions.money import SYMBOLS
from ledger_jobs.operators import wording
from ledger_jobs.operators.wording import Phrase, Wording

BETWEEN = "\x00"
#: White space of patterns, and white space in the Unicode sense.
_S = r"[ \t-\r]"
_WIDE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANK = re.compile(f"{_WIDE}*")
_LETTER = r"[^\W_]"
_LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
_NO_SYMBOLS = str.maketrans(dict.fromkeys(SYMBOLS, ""))

#: Figures with two decimals that are not part of something longer (references, dates, rates).
#: Patterns here begin with a character class or words, and look behind it, so that they are looked for fast.
FIGURE = re.compile(rf"[0-9](?<!{_LETTER}[0-9])(?<![.,/][0-9])(?:[0-9]{{0,2}}(?:,[0-9]{{3}})+|[0-9]*)\.[0-9]{{2}}(?![0-9%/]|\.[0-9])")
_MINUS_BEFORE = re.compile(rf"[-−–]{_S}*(?:[£$€₦]{_S}*)?\Z")
_MINUS_AFTER = re.compile(rf"-|{_S}*(?:DR|OD)(?!{_LETTER})")
_OPEN = re.compile(rf"\({_S}*\Z")
#: Characters in front of a figure in which its sign may stand.
BEFORE = 4
MOST_VALUE = 1e13
# Labels of header lines, by role, in the order in which they are looked for.
LABELS = {
    "out": ("paid out", "money out", "payments out", "withdrawn", "withdrawals", "debits", "debit", "payments", "out"),
    "in": ("paid in", "money in", "payments in", "deposits", "credits", "credit", "receipts", "in"),
    "amount": ("amount",),
    "balance": ("balance",),
    "date": ("date",),
}
_LABEL = {x: re.compile(rf"(?<!{_LETTER}){x}(?!{_LETTER})") for labels in LABELS.values() for x in labels}
SUMMARY = wording.Wording(wording.SUMMARY, ("forward", "balance", "total"))
OPENING = wording.Wording(wording.OPENING, ("forward", "balance", "b/f"))
NOISE = wording.Wording(wording.NOISE, tuple(dict.fromkeys(Phrase.of(p).words[0] for p in wording.NOISE)))
HEADER_HINTS = ("date", "balance")

_D, _W = "[0-9]{1,2}", "[a-z]{3,9}"
#: Dates as they stand in lines: year first, numbers, day-month-year with a name, month name first.
_YEAR = r"[0-9]{2,4}\b"
DATES = (
    re.compile(rf"[0-9](?<!\w[0-9])(?:[0-9]{{3}}[-/]{_D}[-/]{_D}(?:\b|t)|[0-9]?[-/.]{_D}[-/.]{_YEAR}|[0-9]?(?:{_S}|-){_W}(?:{_S}|-){_YEAR})"),
    re.compile(rf"[a-z](?<!\w[a-z])[a-z]{{2,8}}{_S}+{_D},?{_S}+{_YEAR}"),
)
_MONTH = "|".join(MONTHS)
_NTH = "(?:st|nd|rd|th)?"
#: (pattern, group of the month, group of the day)
YEARLESS = (
    (re.compile(rf"([0-9](?<!\w[0-9])[0-9]?){_NTH}{_S}+({_MONTH})[a-z]*\b"), 2, 1),
    (re.compile(rf"({_MONTH})(?<!\w[a-z]{{3}})[a-z]*{_S}+([0-9]{{1,2}}){_NTH}\b"), 1, 2),
)
_NAME = "(?:" + "|".join(sorted({*MONTHS, *FULL_MONTHS}, key=len, reverse=True)) + ")"
_GAP = rf"(?:{_S}*|-)"
_ISO = re.compile(rf"([0-9]{{4}})([-/])({_D})\2({_D})t*")
_FIGURES = re.compile(rf"({_D})([-/.])({_D})\2([0-9]{{4}}|[0-9]{{2}})")
_DAY_NAME = re.compile(rf"({_D}){_GAP}({_NAME}){_GAP}([0-9]{{4}}|[0-9]{{2}})")
_NAME_DAY = re.compile(rf"({_NAME}){_S}*({_D}),{_S}*([0-9]{{4}})")


def day(year: int, month: int, day_: int) -> dt.date | None:
    try:
        return dt.date(year, month, day_)
    except ValueError:
        return None


def year_of(text: str, old: str = "789") -> int | None:
    """1990 to 2100; of two digits those below 70 are of this century and the nineties of the last."""
    if len(text) == 4:
        return int(text) if 1990 <= int(text) <= 2100 else None
    return 2000 + int(text) if text[0] < "7" else 1900 + int(text) if text[0] == "9" else None


@lru_cache(maxsize=1 << 14)
def date_in(token: str) -> dt.date | None:
    """The date that a match of ``DATES``, in lower case, stands for: day first before month first."""
    if m := _ISO.fullmatch(token):
        year = year_of(m[1])
        return year and day(year, int(m[3]), int(m[4]))
    if m := _FIGURES.fullmatch(token):
        year = year_of(m[4])
        if year is None or (m[2] == "." and len(m[4]) == 2):
            return None
        first = day(year, int(m[3]), int(m[1]))
        return first or (day(year, int(m[1]), int(m[3])) if m[2] != "." and len(m[4]) == 4 else None)
    if m := _DAY_NAME.fullmatch(token):
        year = year_of(m[3])
        return year and day(year, MONTHS.index(m[2][:3]) + 1, int(m[1]))
    if m := _NAME_DAY.fullmatch(token):
        year = year_of(m[3])
        return year and day(year, MONTHS.index(m[1][:3]) + 1, int(m[2]))
    return None


def words_of(text: str) -> str:
    """The words of a text without symbols and lone signs."""
    if not text.isascii():
        text = text.translate(_NO_SYMBOLS)
    elif "$" in text:
        text = text.replace("$", "")
    words = text.split() if text.isprintable() else re.split(f"{_WIDE}+", text)
    return " ".join(w for w in words if w.strip("-−–()+"))


def rest_of(line: str, start: int = 0, stop: int = 0) -> str:
    """The text of a line without figures, symbols and its date, which stands from start to stop."""
    return words_of(FIGURE.sub(" ", f"{line[:start]} {line[stop:]}" if stop else line))


def indent_of(line: str) -> int:
    plain = len(line) - len(line.lstrip(" "))
    return plain if line[plain : plain + 1].isprintable() else _BLANK.match(line).end()


class Lines:
    """Lines of a batch, joined, with the patterns' finds by line."""

    def __init__(self, lines: list[str]):
        self.lines, self.text = lines, BETWEEN.join(lines)
        self.low = self.text.translate(_LOWER)
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]

    def finds(self, pattern: re.Pattern, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, start, stop) of all matches, in the joined text."""
        spans = np.array([m.span() for m in pattern.finditer(text)], np.int64).reshape(-1, 2)
        return np.searchsorted(self.start, spans[:, 0], side="right") - 1, spans[:, 0], spans[:, 1]

    def low_line(self, k: int) -> str:
        return self.low[self.start[k] : self.start[k] + len(self.lines[k])]

    def hinted(self, *hints: str) -> list[int]:
        """The lines in which one of some pieces of text stands."""
        return np.unique(self.finds(re.compile("|".join(map(re.escape, hints))), self.low)[0]).tolist()

    def has(self, words: Wording) -> np.ndarray:
        found = np.zeros(len(self.lines), bool)
        found[[k for k in self.hinted(*words.hints) if words.said(self.low_line(k))]] = True
        return found

    def ends(self, words: Wording) -> np.ndarray:
        """Where the first phrase of each line ends; -1 where there is none."""
        out = np.full(len(self.lines), -1, np.int32)
        for k in self.hinted(*words.hints):
            if found := words.find(self.low_line(k)):
                out[k] = found[1]
        return out

    def figures(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, start, stop, value, negative) of all figures.  Negative is what has a minus or a
        bracket before it (also before its symbol), or a minus, DR or OD behind it."""
        line, start, stop = self.finds(FIGURE, self.text)
        ends = self.start[line] + np.fromiter((len(self.lines[k]) for k in line.tolist()), np.int64, len(line))
        same = line[1:] == line[:-1]
        since, until = self.start[line], ends.copy()
        since[1:][same], until[:-1][same] = stop[:-1][same], start[1:][same]
        value, negative = np.zeros(len(line)), np.zeros(len(line), bool)
        for k, (a, b, low, high) in enumerate(zip(start.tolist(), stop.tolist(), since.tolist(), until.tolist(), strict=True)):
            value[k] = float(self.text[a:b].replace(",", ""))
            before = self.text[max(low, a - BEFORE) : a]
            # text behind, a little of it: signs follow at once, or after blanks
            negative[k] = bool(_MINUS_BEFORE.search(before)) or bool(_MINUS_AFTER.match(self.text, b, high)) or (self.text[b:high].startswith(")") and bool(_OPEN.search(before)))
        good = value < MOST_VALUE
        return line[good], (start - self.start[line])[good], (stop - self.start[line])[good], value[good], negative[good]

    def headers(self) -> list[dict | None]:
        """What header lines say: ``placed`` tells that labels are apart, so that their places mean
        something; else the places are null."""
        out: list[dict | None] = [None] * len(self.lines)
        with_figures = set(self.finds(FIGURE, self.text)[0].tolist())
        for k in self.hinted(*HEADER_HINTS):
            if k in with_figures:
                continue
            line = self.lines[k]
            low = line.translate(_LOWER)
            spans = {role: next((m.span() for x in labels if (m := _LABEL[x].search(low))), None) for role, labels in LABELS.items()}
            both, kind = spans["out"] and spans["in"], spans["amount"] and spans["balance"]
            if not ((both or kind) and ("date" in low or spans["balance"])):
                continue
            starts = [s[0] for role, s in spans.items() if s and role != "date"]
            placed = "  " in line[min(starts) : max(starts)]
            out[k] = {"placed": placed} | {role: {"start": s[0], "stop": s[1]} if s and placed else None for role, s in spans.items()}
        return out

    def dates(self) -> list[tuple[dt.date, int, int] | None]:
        """The first date of each line, and where it stands."""
        out: list[tuple[dt.date, int, int] | None] = [None] * len(self.lines)
        finds = sorted(m.span() for pattern in DATES for m in pattern.finditer(self.low))
        lines = (np.searchsorted(self.start, [a for a, _ in finds], side="right") - 1).tolist()
        past = 0
        for k, (a, b) in zip(lines, finds, strict=True):
            if a >= past:  # else inside the find before
                past = b
                if out[k] is None and (found := date_in(self.low[a:b])):
                    out[k] = (found, a - int(self.start[k]), b - int(self.start[k]))
        return out

    def yearless(self, years: list[int], ends: list[dt.date | None]) -> list[tuple[dt.date, int, int] | None]:
        """The first date without a year of each line, in the year given; a year earlier if it lies
        over a month behind the end of the statement.  A figure that is glued to it makes it no date."""
        out: list[tuple[dt.date, int, int] | None] = [None] * len(self.lines)
        seen = -1
        finds = sorted((*m.span(), m[month], m[day_]) for pattern, month, day_ in YEARLESS for m in pattern.finditer(self.low))
        lines = (np.searchsorted(self.start, [f[0] for f in finds], side="right") - 1).tolist()
        for k, (start, stop, name, number) in zip(lines, finds, strict=True):
            if k == seen:
                continue
            seen, line, whole = k, self.lines[k], self.text[start:stop]
            at = line.find(whole)
            behind = line[at + len(whole) : at + len(whole) + 2]
            if (at and line[at - 1] in ".,/:-") or re.match("[.,/:-][0-9]", behind):
                continue
            month, day_ = MONTHS.index(name) + 1, int(number)
            found = day(years[k], month, day_)
            if found and ends[k] and found > ends[k] + dt.timedelta(31):
                found = day(years[k] - 1, month, day_) or found
            if found:
                out[k] = (found, at, at + len(whole))
        return out


_FIGURE = pa.struct([("value", pa.float64()), ("negative", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32())])
_PLACE = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_HEADER = pa.struct([("placed", pa.bool_()), *[(role, _PLACE) for role in LABELS]])
_DATED = pa.struct([("date", pa.date32()), ("start", pa.int32()), ("stop", pa.int32())])
FIGURES = "array<struct<value: double, negative: boolean, start: int, stop: int>>"
SAID = (
    f"header: struct<placed: boolean, {', '.join(f'`{r}`: struct<start: int, stop: int>' for r in LABELS)}>, amounts: {FIGURES}, "
    "full: struct<date: date, start: int, stop: int>, short: struct<date: date, start: int, stop: int>, summary: boolean, noise: boolean, indent: int, "
    "opening_end: int, text_plain: string, text_full: string, text_short: string"
)


def figure_lists(lines: Lines) -> pa.Array:
    line, start, stop, value, negative = lines.figures()
    offsets = np.searchsorted(line, np.arange(len(lines.lines) + 1)).astype(np.int32)
    parts = [pa.array(value), pa.array(negative), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(_FIGURE)))


def _dated(found: list[tuple[dt.date, int, int] | None]) -> pa.Array:
    return pa.array([None if x is None else {"date": x[0], "start": x[1], "stop": x[2]} for x in found], _DATED)


def said(lines: list[str], ends: list[dt.date | None], as_of_year: int) -> dict[str, pa.Array]:
    """The columns of ``SAID``."""
    found = Lines(lines)
    full = found.dates()
    short = found.yearless([as_of_year if e is None else e.year for e in ends], ends)
    opening = found.ends(OPENING)
    without = lambda spans: pa.array([None if s is None else rest_of(x, s[1], s[2]) for x, s in zip(lines, spans, strict=True)], pa.string())
    return {
        "header": pa.array(found.headers(), _HEADER), "amounts": figure_lists(found), "full": _dated(full), "short": _dated(short),
        "summary": pa.array(found.has(SUMMARY)), "noise": pa.array(found.has(NOISE)), "indent": pa.array(list(map(indent_of, lines)), pa.int32()),
        "opening_end": pa.array(opening, mask=opening < 0), "text_plain": pa.array([rest_of(x) for x in lines], pa.string()),
        "text_full": without(full), "text_short": without(short),
    }


def read(line: Column, period_end: Column, as_of_year: int) -> Column:
    """What a line says: ``struct<SAID>``."""

    @F.arrow_udf(f"struct<{SAID}>")
    def run(lines: pa.Array, ends: pa.Array) -> pa.Array:
        more = said(lines.to_pylist(), ends.to_pylist(), as_of_year)
        return pa.StructArray.from_arrays(list(more.values()), names=list(more))

    return run(line, period_end)


def about(texts: list[str], first_lines: int) -> dict[str, pa.Array]:
    """Of whole texts, how many lines have figures, and the latest of the first dates of the first lines."""
    lines = [t.split("\n") for t in texts]
    begin = np.concatenate(([0], np.cumsum([len(x) for x in lines])))
    every = Lines([x for some in lines for x in some])
    owner = np.searchsorted(begin, np.unique(every.finds(FIGURE, every.text)[0]), side="right") - 1
    heads = [x[:first_lines] for x in lines]
    dates = iter(Lines([x for some in heads for x in some]).dates())
    latest = [max((d[0] for _ in some if (d := next(dates))), default=None) for some in heads]
    return {"figure_lines": pa.array(np.bincount(owner, minlength=len(texts))), "period_end": pa.array(latest, pa.date32())}


def describe(text: Column, first_lines: int) -> Column:
    """``struct<figure_lines, period_end>`` of a text."""

    @F.arrow_udf("struct<figure_lines: bigint, period_end: date>")
    def run(texts: pa.Array) -> pa.Array:
        more = about([x or "" for x in texts.to_pylist()], first_lines)
        return pa.StructArray.from_arrays(list(more.values()), names=list(more))

    return run(text)


def strict_amounts(line: Column) -> Column:
    """Figures of a line with their places; a null line has none."""

    @F.arrow_udf(FIGURES)
    def run(lines: pa.Array) -> pa.Array:
        return figure_lists(Lines([x or "" for x in lines.to_pylist()]))

    return run(line)
