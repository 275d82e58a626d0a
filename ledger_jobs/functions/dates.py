"""Dates and clock times in cells and lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledger_jobs.functions.text import UNICODE_SPACE, let

# Month names by their first letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
_NAME = "(" + "|".join(sorted({*MONTHS, *FULL_MONTHS}, key=len, reverse=True)) + ")"
_D, _W = r"\d{1,2}", "[A-Za-z]{3,9}"
#: Dates as they stand in lines: year first, numbers, day-month-year with a name, month name first.
_LINE_SHAPES = (
    rf"\d{{4}}[-/]{_D}[-/]{_D}(?:\b|T)",
    rf"{_D}[-/.]{_D}[-/.]\d{{2,4}}\b",
    rf"{_D}[\s-]{_W}[\s-]\d{{2,4}}\b",
    rf"{_W}\s+{_D},?\s+\d{{2,4}}\b",
)
IN_LINE = r"(?i)\b(" + "|".join(_LINE_SHAPES) + ")"
_MONTH_3 = "(" + "|".join(MONTHS) + ")[a-z]*"
_NTH = r"(\d{1,2})(?:st|nd|rd|th)?"
YEARLESS = rf"(?i)\b(?:{_NTH}\s+{_MONTH_3}|{_MONTH_3}\s+{_NTH})\b"
CLOCK = r"\b(\d{1,2}):(\d{2})(?::(\d{2}))?\b"


def make_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is no such day."""
    dash = F.lit("-")
    return F.concat(year.cast("string"), dash, month.cast("string"), dash, day.cast("string")).try_cast("date")


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at.cast("int"))


def _int(text: Column) -> Column:
    return text.try_cast("int")


_SPACE = UNICODE_SPACE
#: What may stand around a date in a cell: white space, and a clock time behind it.
_AROUND = rf"(?s)^{_SPACE}*%s(?:[T\s]+\d{{1,2}}:\d{{2}}.*)?{_SPACE}*T*$"
# Years from 1990 to 2100 only; of two digits, those below 70 are of this century.
_YEAR, _NEW, _OLD = r"(199\d|20\d{2}|2100)", r"([0-6]\d)", r"(9\d)"
#: Numeric shapes and how they read as year-month-day, day first before month first.
_SHAPES = tuple(
    (_AROUND % shape, read)
    for shape, read in (
        (rf"{_YEAR}([-/])({_D})\2({_D})", "$1-$3-$4"),
        (rf"({_D})([/.-])({_D})\2{_YEAR}", "$4-$3-$1"),
        (rf"({_D})([/-])({_D})\2{_YEAR}", "$4-$1-$3"),
        (rf"({_D})([/-])({_D})\2{_NEW}", "20$4-$3-$1"),
        (rf"({_D})([/-])({_D})\2{_OLD}", "19$4-$3-$1"),
        (rf"{_YEAR}(\d{{2}})(\d{{2}})", "$1-$2-$3"),
    )
)
_GAP = r"(?:\s*|-)"
_NAMED = (
    (_AROUND % rf"({_D}){_GAP}(?i:{_NAME}){_GAP}(199\d|20\d{{2}}|2100|[0-69]\d)", 3, 2, 1),
    (_AROUND % rf"(?i:{_NAME})\s*({_D}),\s*{_YEAR}", 3, 1, 2),
)


def parse_date(raw: Column) -> Column:
    """The date in a cell: ISO, day first before month first, with names, or eight digits; a clock
    time behind it is dropped.  Years outside 1990 to 2100 are no dates."""
    # every branch is guarded by what the cell starts with, so that other text costs two looks
    numeric = F.coalesce(*[F.when(raw.rlike(p), F.regexp_replace(raw, p, read).try_cast("date")) for p, read in _SHAPES])

    def named(pattern: str, y: int, m: int, d: int) -> Column:
        part = lambda k: F.regexp_extract(raw, pattern, k)
        century = F.when(F.length(part(y)) == 4, "").when(part(y) < "70", "20").otherwise("19")
        return F.when(raw.rlike(pattern), make_date(F.concat(century, part(y)), month_number(part(m)), part(d)))

    return F.when(raw.rlike(rf"^{_SPACE}*(?:\d{{1,2}}[-/.]\d|\d{{4}}[-/]\d|\d{{8}})"), numeric).when(
        raw.rlike(rf"^{_SPACE}*(?:\d{{1,2}}{_GAP})?[A-Za-z]{{3}}"), F.coalesce(*[named(*n) for n in _NAMED])
    )


def find_date(line: Column) -> Column:
    """The first date in a line."""

    def rest(first: Column) -> Column:
        later = F.filter(F.transform(F.regexp_extract_all(line, F.lit(IN_LINE), F.lit(1)), parse_date), lambda d: d.isNotNull())
        return F.coalesce(parse_date(first), F.when(first != "", F.get(later, F.lit(0))))

    return F.when(line.rlike(r"\d"), let(F.regexp_extract(line, IN_LINE, 1), rest))


def find_date_span(line: Column) -> Column:
    """The first date in a line and where it stands: ``struct<date, start, stop>`` in characters."""
    found, between = F.regexp_extract_all(line, F.lit(IN_LINE), F.lit(1)), F.split(line, IN_LINE, -1)

    def first(x: Column) -> Column:
        def placed(t: Column, i: Column) -> Column:
            start = F.char_length(F.array_join(F.slice(x.gaps, F.lit(1), i + 1), "")) + F.char_length(F.array_join(F.slice(x.found, F.lit(1), i), ""))
            return F.struct(parse_date(t).alias("date"), start.cast("int").alias("start"), (start + F.char_length(t)).cast("int").alias("stop"))

        return F.get(F.filter(F.transform(x.found, placed), lambda d: d.date.isNotNull()), F.lit(0))

    return F.when(line.rlike(IN_LINE), let(F.struct(found.alias("found"), between.alias("gaps")), first))


def find_yearless_span(line: Column, year: Column) -> Column:
    """The first date without a year ("5 Oct", "Oct 5th"), in ``year``, and where it stands:
    ``struct<date, start, stop>``; a figure that is glued to it makes it no date."""
    whole = F.regexp_extract(line, YEARLESS, 0)
    group = lambda k: F.regexp_extract(line, YEARLESS, k)
    day = _int(F.coalesce(F.nullif(group(1), F.lit("")), group(4)))
    month = month_number(F.coalesce(F.nullif(group(2), F.lit("")), group(3)))
    at = F.position(whole, line)
    before, after = F.substring(line, F.lit(1), at - 1), F.substring(line, at + F.length(whole), F.lit(2))
    glued = before.rlike("[.,/:-]$") | after.rlike("^[.,/:-][0-9]")
    span = F.struct(make_date(year, month, day).alias("date"), (at - 1).alias("start"), (at - 1 + F.char_length(whole)).alias("stop"))
    return F.when(line.rlike(YEARLESS), F.when(~glued, let(span, lambda x: F.when(x.date.isNotNull(), x))))


def find_yearless_date(line: Column, year: Column) -> Column:
    return find_yearless_span(line, year).date


def find_time(line: Column) -> Column:
    """Seconds of the day of the first clock time; null if that one is none."""
    h, m, s = (_int(F.regexp_extract(line, CLOCK, k)) for k in (1, 2, 3))
    s = F.coalesce(s, F.lit(0))
    return F.when(line.rlike(CLOCK) & (h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)
