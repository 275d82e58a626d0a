"""Money cells and money tokens as column expressions.

A money value is ``struct(value double, negative_hint boolean)``, null where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledger_jobs.functions.text import UNICODE_SPACE, let, trim

#: Currency symbols that are dropped from descriptions. Fixed values.
SYMBOLS = "₦$£€¥₹₵₿₩"
#: A number that may be money inside a line.
TOKEN = r"[-+]?\(?[0-9][0-9.,]*[0-9]\)?"


def normalise_separators(s: Column) -> Column:
    """Digits with ``.`` and ``,`` to a plain decimal number.

    With both, the right-most is the decimal point.  A comma alone is one if there is a single
    comma with one or two digits after it; dots alone separate thousands if there are several, or
    one with exactly three digits after it.
    """
    commas, dots = F.size(F.split(s, ",")) - 1, F.size(F.split(s, r"\.")) - 1
    after_comma, after_dot = (F.length(F.substring_index(s, c, -1)) for c in ",.")
    no_commas, no_dots = F.replace(s, F.lit(",")), F.replace(s, F.lit("."))
    comma_is_point = F.replace(no_dots, F.lit(","), F.lit("."))
    both = F.when(after_dot < after_comma, no_commas).otherwise(comma_is_point)
    one_comma = (commas == 1) & after_comma.isin(1, 2)
    thousands = (dots > 1) | ((dots == 1) & (after_dot == 3))
    return (
        F.when((commas > 0) & (dots > 0), both)
        .when(commas > 0, F.when(one_comma, comma_is_point).otherwise(no_commas))
        .when(thousands, no_dots)
        .otherwise(s)
    )


def parse_amount(raw: Column) -> Column:
    """The number in a cell and whether it is marked as negative: by brackets, by a word DR or OD,
    or by a minus before the first digit or at the end.  Null without a number, from 1e13 on, and
    for whole numbers of more than twelve digits."""
    signs = F.regexp_replace(trim(raw), "[−–]", "-")

    def read(dashed: Column) -> Column:
        brackets = F.contains(dashed, F.lit("(")) & F.contains(dashed, F.lit(")"))
        marked = rf"(?i)(?<![a-zA-Z])(dr|od)(?![a-zA-Z])|^[^0-9]*-|-{UNICODE_SPACE}*$"
        kept = F.regexp_replace(F.regexp_replace(dashed, "[^0-9.,-]", ""), "^-+|-+$", "")
        number = let(kept, normalise_separators)
        return F.struct(number.alias("number"), (brackets | dashed.rlike(marked)).alias("hint"))

    def value(x: Column) -> Column:
        # at most one point and no sign inside: what is left is a number in full
        plain = x.number.rlike(r"^([0-9]+\.[0-9]*|[0-9]{1,12}|\.[0-9]+)$")
        return F.when(plain, F.struct((x.number.try_cast("double") * F.when(x.hint, -1).otherwise(1)).alias("value"), x.hint.alias("negative_hint")))

    return let(let(let(signs, read), value), lambda m: F.when(F.abs(m.value) < 1e13, m))


def find_amounts(line: Column) -> Column:
    """Money tokens of a line, left to right, as ``array<struct<token, money, decimal>>``.

    Whole numbers need five to nine digits.  If any token ends in one or two decimals, only such
    tokens stay.
    """
    tokens = F.regexp_extract_all(line, F.lit(f"({TOKEN})"), F.lit(1))

    def read(token: Column) -> Column:
        fraction = F.regexp_replace(F.when(F.contains(token, F.lit(".")), F.substring_index(token, ".", -1)), "[^0-9]", "")
        return F.struct(
            token.alias("token"),
            parse_amount(token).alias("money"),
            F.coalesce(F.length(fraction).isin(1, 2), F.lit(False)).alias("decimal"),
        )

    def counts(token: Column) -> Column:
        digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
        return token.rlike("[.,]") | digits.between(5, 9)

    found = F.filter(F.transform(F.filter(tokens, counts), read), lambda x: x.money.isNotNull())
    return let(found, lambda f: F.when(F.exists(f, lambda x: x.decimal), F.filter(f, lambda x: x.decimal)).otherwise(f))


def without_amounts(line: Column) -> Column:
    """A line without the tokens of ``find_amounts`` and without currency symbols."""
    stripped = F.aggregate(
        find_amounts(line), line, lambda text, x: F.regexp_replace(text, F.concat(F.lit(r"(?<![0-9.,])\Q"), x.token, F.lit(r"\E(?![0-9])")), F.lit(" "))
    )
    return F.translate(stripped, SYMBOLS, "")


def round2(x: Column) -> Column:
    """Two decimals, half away from zero."""
    return F.round(x, 2)


def fmt_money(symbol: Column, value: Column) -> Column:
    """``-£1,234.50``: sign, symbol, thousands, two decimals; from 1e15 on without thousands."""
    sign = F.when(value < 0, "-").otherwise("")
    grouped = F.concat(sign, symbol, F.format_number(F.round(F.abs(value), 2), 2))
    plain = F.concat(symbol, F.format_string("%.2f", value))
    return F.when(F.isnan(value) | (F.abs(value) >= 1e15), plain).otherwise(grouped)
