"""Wording: white space, truncation, direction of a transaction from free text or a type cell."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense; plain ``\\s`` and ``trim`` leave no-break spaces.
UNICODE_SPACE = r"\p{IsWhite_Space}"

# Phrases (anywhere) and codes (whole words) that mean money out or money in.
DEBIT_PHRASES = (
    "withdrawal", "debit", "transfer to", "payment", "purchase", "charge", "fee", "levy", "vat", "bill",
    "airtime", "outflow", "paid out", "paid to", "sent to", "standing order", "contactless", "cash machine",
)
CREDIT_PHRASES = (
    "deposit", "credit", "salary", "transfer from", "payment from", "received", "refund", "reversal",
    "inflow", "paid in", "received from", "interest", "income", "lodgement", "cashback",
)
DEBIT_CODES = ("dr", "pos", "atm", "dd", "so", "vis", "deb", "fpo", "cpt", "chq", "chg", "bp")
CREDIT_CODES = ("cr", "fpi", "bgc", "dep")
# Type cells.
CREDIT_TYPES = ("c", "cr", "fpi", "bgc", "dep", "in")
DEBIT_TYPES = ("d", "dr", "dd", "d/d", "so", "s/o", "deb", "fpo", "cpt", "chq", "pos", "atm", "out")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it: as the variable
    of a lambda it does not multiply the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def clean(s: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, f"{UNICODE_SPACE}+", " "))


def truncate(s: Column, most: int) -> Column:
    """The first ``most`` characters and an ellipsis if there are more."""
    return F.when(F.char_length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def classify_text(line: Column, negative: Column) -> Column:
    """debit or credit by phrases and codes; if both or neither occur, by the sign."""

    def hit(phrases: tuple[str, ...], codes: tuple[str, ...]) -> Column:
        whole = r"(?<![\p{L}\p{N}])(?:" + "|".join(codes) + r")(?![\p{L}\p{N}])"
        return F.lower(line).rlike("|".join(phrases) + "|" + whole)

    sides = F.struct(hit(DEBIT_PHRASES, DEBIT_CODES).alias("debit"), hit(CREDIT_PHRASES, CREDIT_CODES).alias("credit"))
    by_sign = F.when(negative, "debit").otherwise("credit")
    return let(sides, lambda x: F.when(x.debit & ~x.credit, "debit").when(x.credit & ~x.debit, "credit").otherwise(by_sign))


def direction_from_type(cell: Column) -> Column:
    """debit or credit from a transaction type cell, or null."""
    low = trim(F.lower(cell))
    return F.when(low.isin(*CREDIT_TYPES) | low.rlike("credit|deposit"), "credit").when(
        low.isin(*DEBIT_TYPES) | low.rlike("debit|withdraw|card payment"), "debit"
    )


def anchor_words(keyword: Column) -> Column:
    """The words of at least three bytes of ``keyword``, in lower case; without any, the whole of it."""
    low = F.lower(keyword)
    words = F.filter(F.split(trim(low), f"{UNICODE_SPACE}+"), lambda w: F.octet_length(w) >= 3)
    return F.when(F.size(words) > 0, words).otherwise(F.array(low))


def tokens_any_match(keyword: Column, *texts: Column) -> Column:
    """Whether any of the words of ``keyword`` (``anchor_words``) is in any of the texts.  An empty
    keyword matches."""
    wanted = anchor_words(keyword)

    def within(text: Column) -> Column:
        return F.exists(wanted, lambda w: F.contains(F.lower(text), w))

    found = reduce(or_, map(within, texts))
    return (F.lower(keyword) == "") | F.coalesce(found, F.lit(False))
