"""Currency of a statement: symbols and names counted over its text.

Symbols and words of all fifteen currencies are picked out of a text (a whole block, a line or a row
of cells) in one pass each and counted among what was found; sums per statement are combined before they are shuffled.  Only the first 256 KiB of a statement
are looked at; they are cut from the text where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_BYTES = 256 * 1024
# Symbol, code, name, words.
DEFINITIONS = (
    ("₦", "NGN", "Nigerian Naira", ("ngn", "naira")),
    ("$", "USD", "US Dollar", ("usd", "us$", "dollar")),
    ("£", "GBP", "British Pound", ("gbp", "pound", "sterling")),
    ("€", "EUR", "Euro", ("eur", "euro")),
    ("¥", "JPY", "Japanese Yen", ("jpy", "yen")),
    ("₹", "INR", "Indian Rupee", ("inr", "rupee")),
    ("₵", "GHS", "Ghanaian Cedi", ("ghs", "cedi")),
    ("R", "ZAR", "South African Rand", ("zar", "rand")),
    ("KSh", "KES", "Kenyan Shilling", ("kes", "ksh", "shilling")),
    ("₿", "BTC", "Bitcoin", ("btc", "bitcoin", "sats")),
    ("C$", "CAD", "Canadian Dollar", ("cad",)),
    ("A$", "AUD", "Australian Dollar", ("aud",)),
    ("Fr", "CHF", "Swiss Franc", ("chf", "franc")),
    ("₩", "KRW", "South Korean Won", ("krw", "won")),
    ("د.إ", "AED", "UAE Dirham", ("aed", "dirham")),
)
SORT_CODE = r"\b\d{2}-\d{2}-\d{2}\b[ ,]+\d{8}\b"
SYMBOL_POINTS, WORD_POINTS = 12, 8


def _quoted(text: str) -> str:
    return rf"\Q{text}\E"


def _whole(words: tuple[str, ...]) -> str:
    return f"(?<![a-z0-9])(?:{'|'.join(map(_quoted, words))})(?![a-z0-9])"


def _counts(symbol: str) -> bool:
    """Symbols that are only letters do not count."""
    return not (symbol.isascii() and symbol.isalnum())


def signs_in(text: Column) -> Column:
    """The symbols of a text, ``$`` with the letter before it, in one pass."""
    single = "".join(s for s, *_ in DEFINITIONS if len(s) == 1 and _counts(s) and s != "$")
    longer = "|".join(_quoted(s) for s, *_ in DEFINITIONS if len(s) > 1 and _counts(s) and not s.endswith("$"))
    return F.array_join(F.regexp_extract_all(text, F.lit(rf"[A-Z]?\$|[{single}]|{longer}"), F.lit(0)), " ")


def words_in(text: Column) -> Column:
    """The words of all currencies in a text, in one pass."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(_whole(tuple(w for *_, words in DEFINITIONS for w in words))), F.lit(0)), " ")


def score(signs: Column, named: Column, symbol: str, words: tuple[str, ...]) -> Column:
    """Points of one currency among the symbols and words of a text."""
    points = SYMBOL_POINTS * F.regexp_count(signs, F.lit(_quoted(symbol))) if _counts(symbol) else F.lit(0)
    return points + WORD_POINTS * F.regexp_count(named, F.lit(_whole(words)))


def sampled(text: Column, at: Column) -> Column:
    """The part of a text, before which ``at`` bytes of its statement stand, in the sample."""
    left = F.greatest(SAMPLE_BYTES - at, F.lit(0)).cast("int")
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), F.lit(1), left).cast("string"))
    return F.when(F.octet_length(text) <= left, text).otherwise(cut)


def detect(texts: DataFrame) -> DataFrame:
    """One row per statement of (doc_id, at, text), ``at`` being the bytes of the statement before a
    text: symbol, code, name, confidence (share of all points), detected_by.  Ties go to the
    earlier definition."""
    rows = texts.select("doc_id", sampled(F.col("text"), F.col("at")).alias("line")).withColumns({"signs": signs_in(F.col("line")), "named": words_in(F.col("line"))})
    scores = [F.sum(score(F.col("signs"), F.col("named"), d[0], d[3])).alias(f"s{k}") for k, d in enumerate(DEFINITIONS)]
    word = r"(?<![a-z0-9])sort code(?![a-z0-9])"
    hint = F.bool_or(F.lower("line").rlike(word) | F.col("line").rlike(SORT_CODE)).alias("hint")
    summed = rows.groupBy("doc_id").agg(*scores, hint)
    points = F.array(*[F.col(f"s{k}") for k in range(len(DEFINITIONS))])
    best = F.array_max(points)
    pick = (F.array_position(points, best) - 1).cast("int")
    known = F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(c).alias("code"), F.lit(n).alias("name")) for s, c, n, _ in DEFINITIONS])
    nothing = F.struct(F.lit("").alias("symbol"), F.lit("UNKNOWN").alias("code"), F.lit("Not detected").alias("name"))
    sterling = next(k for k, d in enumerate(DEFINITIONS) if d[1] == "GBP")
    found = F.when(best > 0, F.get(known, pick)).when(F.col("hint"), known[sterling]).otherwise(nothing)
    total = F.aggregate(points, F.lit(0).cast("long"), lambda a, b: a + b)
    share = F.when(best > 0, F.round(best / total, 2)).when(F.col("hint"), 0.6).otherwise(0.0)
    how = F.when(best > 0, "symbol").when(F.col("hint"), "UK sort code").otherwise("none")
    return summed.select("doc_id", found.alias("f"), share.alias("confidence"), how.alias("detected_by")).select(
        "doc_id", "f.symbol", "f.code", "f.name", "confidence", "detected_by"
    )
