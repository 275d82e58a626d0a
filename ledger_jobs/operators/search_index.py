"""Many searches against many transactions by equal keys only.

A search is filed under one kind of condition that it has, the most telling first: its words, each
together with the days of its range (or its amounts, or its side and hours).

* Words: which words of all searches stand in a transaction is found in one pass over its text, with
  an Aho-Corasick automaton of the distinct words while these are at most ``AUTOMATON_BYTES``; more of
  them are looked up by a join, under their first 1, 2, 4 or 8 characters.
* Ranges of days and of amounts are covered by dyadic intervals, two of each length at most, and
  exactly one of them holds a given day or amount.  Amounts are filed by the logarithm, in steps of
  a 64th; the exact bounds are looked at in the pair.
* Side and hours of the day are keys as they are.

So a range is a few keys, whatever its length, and a transaction has as many keys as there are
interval lengths in use: the join is one on equal (word, level, cell), which can be shuffled, broadcast
or split by the engine.  Of a pair the word is known to stand in the text; the rest are candidates, for which the caller's
condition is part of the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_jobs.functions.text import let
from ledger_jobs.sources.shared import kept

try:
    import ahocorasick
except ImportError:  # words are then looked up by a join
    ahocorasick = None

#: Bytes of distinct words up to which each Python worker holds one automaton of all of them.
AUTOMATON_BYTES = 8 << 20
#: Lengths under whose first characters words are looked up otherwise.
GRAMS = (1, 2, 4, 8)
#: Interval lengths 1 to 2**TOP; days since 1970 and filed amounts are smaller than 2**TOP.
TOP = 22
STEPS = 64
#: Levels of days begin at 0, those of amounts and of side and hours here.
AMOUNTS, SIDES = 100, 200
SIDE_AND_HOUR, HOUR, SIDE, ANY = range(SIDES, SIDES + 4)
NO_HOUR = 24
KEY = ["word", "level", "cell"]


class Ask(NamedTuple):
    """What can be filed of a search: words (array, any of which must stand in description or raw;
    none if empty), first and last day, least and largest amount, side, hours (array of lo and hi)."""

    words: Column
    first: Column
    last: Column
    least: Column
    most: Column
    side: Column
    hours: Column


def filed_amount(amount: Column) -> Column:
    """A whole number that does not fall as the amount grows."""
    inside = F.greatest(F.least(amount, F.lit(1e18)), F.lit(0.0))
    return F.when(amount.isNotNull(), F.floor(F.log1p(inside) * STEPS).cast("long"))


MOST_FILED = math.floor(math.log1p(1e18) * STEPS) + 1


def cover(first: Column, last: Column, base: int) -> Column:
    """The dyadic intervals that make up ``first`` to ``last``: ``array<struct<level, cell>>``.

    Of a level, those inside the range whose parent is not: one at either end at most, or two
    neighbours if no parent is inside."""

    def of(x: Column) -> Column:
        def level(k: Column) -> Column:
            inside = lambda n: (-F.call_function("shiftright", -x.first, n), F.call_function("shiftright", x.last + 1, n) - 1)
            (low, high), (low_up, high_up) = inside(k), inside(k + 1)
            top = (low_up > high_up) | (k == TOP)
            cell = lambda at: F.struct((k + base).cast("int").alias("level"), at.cast("long").alias("cell"))
            ends = F.array(F.when(top | (low % 2 != 0), cell(low)), F.when(top | (high % 2 == 0), cell(high)))
            return F.when(low <= high, F.array_distinct(F.array_compact(ends))).otherwise(F.array().cast("array<struct<level: int, cell: bigint>>"))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TOP)), level))

    return let(F.struct(first.cast("long").alias("first"), last.cast("long").alias("last")), of)


def _cells(base: int, value: Column, levels: list[int]) -> list[Column]:
    """The interval of each level in use that holds a value."""
    mine = [n for n in levels if base <= n <= base + TOP]
    return [F.struct(F.lit(n).alias("level"), F.shiftright(value, n - base).cast("long").alias("cell")) for n in mine]


def _mixed(side: Column, hour: Column) -> Column:
    return F.xxhash64(side, hour.cast("int"))


def file_searches(searches: DataFrame, ask: Ask) -> DataFrame:
    """``searches`` once per key: word, level, cell."""
    day = lambda c: F.unix_date(c).cast("long")
    dated, priced = ask.first.isNotNull() & ask.last.isNotNull(), ask.least.isNotNull() | ask.most.isNotNull()
    amounts = cover(F.coalesce(filed_amount(ask.least), F.lit(0)), F.coalesce(filed_amount(ask.most), F.lit(MOST_FILED)), AMOUNTS)
    sequence = F.sequence(F.lit(0), F.lit(NO_HOUR))
    hours = F.filter(sequence, lambda h: (h == NO_HOUR) | F.exists(ask.hours, lambda r: h.between(r.lo, r.hi)))
    cell = lambda level, value: F.struct(F.lit(level).alias("level"), value.cast("long").alias("cell"))
    timed = F.size(ask.hours) > 0
    rest = (
        F.when(timed & ask.side.isNotNull(), F.transform(hours, lambda h: cell(SIDE_AND_HOUR, _mixed(ask.side, h))))
        .when(timed, F.transform(hours, lambda h: cell(HOUR, h)))
        .when(ask.side.isNotNull(), F.array(cell(SIDE, F.xxhash64(ask.side))))
        .otherwise(F.array(cell(ANY, F.lit(0))))
    )
    cells = F.when(dated, cover(day(ask.first), day(ask.last), 0)).when(priced, amounts).otherwise(rest)
    worded = searches.withColumn("word", F.explode(F.when(F.size(ask.words) > 0, F.array_distinct(ask.words)).otherwise(F.array(F.lit("")))))
    return worded.select("*", F.inline(cells))


@lru_cache(maxsize=2)
def _automaton(words: tuple[str, ...]):
    found = ahocorasick.Automaton()
    for word in words:
        found.add_word(word, word)
    found.make_automaton()
    return found


def _finder(words: Broadcast):
    """Array of the words that stand in either of two texts."""

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        look = _automaton(words.value)
        for one, other in batches:
            seen: dict[tuple, list[str]] = {}
            out = []
            for texts in zip(one, other, strict=True):
                if texts not in seen:
                    seen[texts] = list({w for t in texts if t for _, w in look.iter(t)})
                out.append(seen[texts])
            yield pd.Series(out, dtype=object)

    return found


def _looked_up(txns: DataFrame, words: DataFrame) -> DataFrame:
    """``txns`` with ``found``, by joins: words under their first characters, texts under all theirs."""
    texts = ("description", "raw")
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in texts]
    distinct = kept(txns.select(*[c.alias(f"low_{k}") for k, c in enumerate(low)]).distinct())
    length = F.char_length("word")
    size = F.when(length >= GRAMS[-1], GRAMS[-1])
    for n in reversed(GRAMS[:-1]):
        size = size.when(length >= n, n)
    keyed = words.withColumn("size", size).withColumn("gram", F.expr("substring(word, 1, size)"))

    def grams(text: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.char_length(text) - n + 1)
        return F.when(F.char_length(text) >= n, F.transform(at, lambda k: F.substring(text, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.flatten(F.array(*[grams(F.col(f"low_{k}"), n) for k in (0, 1) for n in GRAMS])))
    pairs = distinct.withColumn("gram", F.explode(every)).join(keyed, "gram").filter("contains(low_0, word) OR contains(low_1, word)")
    found = pairs.groupBy("low_0", "low_1").agg(F.collect_set("word").alias("found"))
    joined = txns.withColumns({f"low_{k}": c for k, c in enumerate(low)}).join(found, ["low_0", "low_1"], "left").drop("low_0", "low_1")
    return joined.withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


def with_words(txns: DataFrame, filed: DataFrame) -> DataFrame:
    """``txns`` with ``found``: which words of filed searches stand in description or raw."""
    words = kept(filed.filter("word <> ''").select("word").distinct())
    size = words.agg(F.sum(F.octet_length("word") + 8)).first()[0] or 0
    if not size:
        return txns.withColumn("found", F.array().cast("array<string>"))
    if ahocorasick is None or size > AUTOMATON_BYTES:
        return _looked_up(txns, words)
    sent = txns.sparkSession.sparkContext.broadcast(tuple(sorted(r.word for r in words.collect())))
    return txns.withColumn("found", _finder(sent)(F.lower("description"), F.lower("raw")))


def file_transactions(txns: DataFrame, plain: list[int], worded: list[int]) -> DataFrame:
    """``txns`` (with ``found``) once per key of the levels in use: those of searches without words,
    and for each word found those of searches with words."""
    hour = F.coalesce(F.floor(F.col("time_sec") / 3600).cast("int"), F.lit(NO_HOUR))
    sides = {SIDE_AND_HOUR: _mixed(F.col("direction"), hour), HOUR: hour, SIDE: F.xxhash64("direction"), ANY: F.lit(0)}

    def cells(levels: list[int]) -> Column:
        found = _cells(0, F.unix_date("date").cast("long"), levels) + _cells(AMOUNTS, filed_amount(F.col("amount")), levels)
        found += [F.struct(F.lit(n).alias("level"), sides[n].cast("long").alias("cell")) for n in levels if n in sides]
        return F.filter(F.array(*found), lambda x: x.cell.isNotNull()) if found else F.array().cast("array<struct<level: int, cell: bigint>>")

    words = txns.withColumn("word", F.explode(F.array_append("found", F.lit("")) if plain else F.col("found"))).drop("found")
    return words.select("*", F.inline(F.when(F.col("word") == "", cells(plain)).otherwise(cells(worded))))


def meet(txns: DataFrame, searches: DataFrame, condition: Column, ask: Ask) -> DataFrame:
    """Pairs of ``t`` and ``q`` that fulfil the condition.  A search of several words meets a
    transaction once for each that stands in it."""
    filed = kept(file_searches(searches, ask))
    used = filed.select("level", (F.col("word") == "").alias("plain")).distinct().collect()  # 100 at most
    if not used:  # no search
        return txns.alias("t").join(searches.alias("q"), condition & F.lit(False))
    plain, worded = (sorted(r.level for r in used if r.plain == p) for p in (True, False))
    rows = file_transactions(with_words(txns, filed), plain, worded)
    t, q = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"q.{c}"))
    equal = (t("word") == q("word")) & (t("level") == q("level")) & (t("cell") == q("cell"))
    return rows.alias("t").join(filed.alias("q"), equal & condition)
