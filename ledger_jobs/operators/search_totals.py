"""How many statements and transactions each search finds, and their net amount, without its matches.

The work follows distinct conditions and transactions, not matches.

* Searches that ask the same are looked at once.  All but the bounds of the amount is their frame;
  only frames meet transactions (``match.meet``).
* Within a frame an amount is a place among the distinct bounds of that frame: even between two
  bounds, odd on one.  Transactions that lie at one place, with the same place before them in their
  statement, are one cell.
* Matches are running totals up to the upper place less those below the lower one.  Of a statement
  only its first match counts, which is the one whose place before it is below the lower bound: the
  lower bounds for which that is so are covered by dyadic intervals, and the running total up to the
  upper place is taken in each interval that holds the lower bound.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_jobs.operators import match
from ledger_jobs.operators.search_index import cover
from ledger_jobs.operators.stats import exact_sum
from ledger_jobs.sources.shared import kept, parallelism

FRAME = ["keyword", "direction", "date_from", "date_to", "hours_text"]
#: The level of running totals over a whole frame; dyadic intervals begin at 0.
WHOLE = -1


class Bounds(NamedTuple):
    """Distinct bounds of all frames: frames and values in order, and pairs of both as one number."""

    frames: np.ndarray
    values: np.ndarray
    pairs: np.ndarray

    @classmethod
    def of(cls, frames: np.ndarray, bound_frames: np.ndarray, bounds: np.ndarray) -> Bounds:
        frames, values = np.unique(frames), np.unique(bounds)
        pairs = np.searchsorted(frames, bound_frames) * (len(values) + 1) + np.searchsorted(values, bounds)
        return cls(frames, values, np.unique(pairs))

    def places(self, frame: np.ndarray, amount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each amount in its frame, and the frame's last one."""
        first = np.searchsorted(self.frames, frame) * (len(self.values) + 1)
        before = lambda rank: np.searchsorted(self.pairs, first + rank)
        start = before(0)
        place = sum(before(np.searchsorted(self.values, amount, side)) - start for side in ("left", "right"))
        return place, 2 * (before(len(self.values)) - start)


def _placed(bounds: Bounds, txns: DataFrame):
    """The place of an amount; one behind all others for none."""
    sent = txns.sparkSession.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def place(frame: pa.Array, amount: pa.Array) -> pa.Array:
        places, last = sent.value.places(frame.to_numpy(zero_copy_only=False), amount.fill_null(0.0).to_numpy(zero_copy_only=False))
        return pa.array(np.where(amount.is_null().to_numpy(zero_copy_only=False), last + 1, places).astype(np.int32))

    return place


def _same(one: str, other: str, columns: list[str]) -> Column:
    equal = F.lit(True)
    for c in columns:
        equal = equal & F.col(f"{one}.{c}").eqNullSafe(F.col(f"{other}.{c}"))
    return equal


def _cells(txns: DataFrame, frames: DataFrame, place) -> DataFrame:
    """(frame, before, place, n, net): transactions of a frame by their place and by that of the
    amount before theirs in their statement (-1: none)."""
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    # by statement first: what meets the frames stays where it is
    txns = txns.select("doc_id", "date", "time_sec", "description", "raw", "direction", "amount").repartition(parallelism(txns.sparkSession), "doc_id")
    found = match.meet(txns, frames, match.passes(), match.asked(), match.passes(keyword=False))
    rows = found.select("q.frame", "t.doc_id", "t.amount", "t.direction")
    earlier = F.lag(F.struct("amount")).over(Window.partitionBy("frame", "doc_id").orderBy(F.asc_nulls_last("amount")))
    rows = rows.withColumns({"signed": signed.cast("decimal(20,4)"), "earlier": earlier})
    before = F.when(F.col("earlier").isNull(), -1).otherwise(place(F.col("frame"), F.col("earlier.amount")))
    rows = rows.select("frame", "signed", before.alias("before"), place(F.col("frame"), F.col("amount")).alias("place"))
    return kept(rows.groupBy("frame", "before", "place").agg(F.count("*").alias("n"), exact_sum(F.col("signed")).alias("net")))


def totals(txns: DataFrame, searches: DataFrame) -> DataFrame:
    """(query_id, statements, matched, net) of searches without anchors that match anything.

    Distinct bounds of amounts are sent to all executors: sixteen bytes each, and at most two a
    search; a frame may have a million of them."""
    hours = F.to_json("hours")
    asks = searches.select("query_id", F.lower("keyword").alias("keyword"), "direction", "date_from", "date_to", "hours", hours.alias("hours_text"), "amount_min", "amount_max")
    frames = kept(asks.groupBy(*FRAME).agg(F.first("hours").alias("hours"))).withColumn("frame", F.monotonically_increasing_id())
    none = F.lit(None).cast("double")
    frames = kept(frames.withColumns({"amount_min": none, "amount_max": none}))
    framed = kept(asks.alias("a").join(frames.alias("f"), _same("a", "f", FRAME)).select("a.query_id", "f.frame", "a.amount_min", "a.amount_max"))
    ranges = kept(framed.select("frame", "amount_min", "amount_max").distinct())
    bounds = ranges.select("frame", F.explode(F.array_compact(F.array("amount_min", "amount_max"))).alias("bound")).distinct().toArrow()
    known = frames.select("frame").toArrow()["frame"].to_numpy()
    place = _placed(Bounds.of(known, bounds["frame"].to_numpy(), bounds["bound"].to_numpy()), txns)
    low, high, end = place(F.col("frame"), F.col("amount_min")), place(F.col("frame"), F.col("amount_max")), place(F.col("frame"), none)
    lowest = F.when(F.col("amount_min").isNull(), 0).otherwise(low)
    # a bound on one side leaves out what has no amount, which is at the end
    highest = F.when(F.col("amount_max").isNotNull(), high).otherwise(end - F.when(F.col("amount_min").isNotNull(), 1).otherwise(0))
    ranges = kept(ranges.withColumns({"low": lowest, "high": highest}).filter("low <= high"))

    cells = _cells(txns, frames, place)
    whole = cells.groupBy("frame", F.lit(WHOLE).alias("level"), F.lit(0).cast("long").alias("cell"), "place").agg(F.sum("n").alias("n"), F.sum("net").cast("decimal(38,4)").alias("net"))
    first = cells.filter("before < place").select("frame", "place", "n", F.inline(cover(F.col("before") + 1, F.col("place"), 0)))
    first = kept(first.groupBy("frame", "level", "cell", "place").agg(F.sum("n").alias("n"), F.lit(None).cast("decimal(38,4)").alias("net")))
    used = sorted(r.level for r in first.select("level").distinct().collect())
    looks = [F.struct(F.lit(WHOLE).alias("level"), F.lit(0).cast("long").alias("cell"), at.alias("place"), F.lit(sign).alias("sign")) for at, sign in ((F.col("high"), 1), (F.col("low") - 1, -1))]
    looks += [F.struct(F.lit(k).alias("level"), F.shiftright("low", k).cast("long").alias("cell"), F.col("high").alias("place"), F.lit(1).alias("sign")) for k in used]
    looked = ranges.select("frame", "low", "high", F.inline(F.array(*looks)))
    every = whole.unionByName(first).unionByName(looked, allowMissingColumns=True)
    # what lies at a place comes before those who look there
    running = Window.partitionBy("frame", "level", "cell").orderBy("place", F.col("sign").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    summed = every.withColumns({"n": F.coalesce(F.sum("n").over(running), F.lit(0)), "net": F.sum("net").over(running)}).filter("sign IS NOT NULL")
    matched = F.sum(F.when(F.col("level") == WHOLE, F.col("n") * F.col("sign")))
    told = summed.groupBy("frame", "low", "high").agg(
        F.coalesce(F.sum(F.when(F.col("level") != WHOLE, F.col("n"))), F.lit(0)).alias("statements"), matched.alias("matched"),
        F.sum(F.when(F.col("sign") > 0, F.col("net")).otherwise(-F.col("net"))).alias("net"),
    )
    told = ranges.join(told, ["frame", "low", "high"]).filter("matched > 0").drop("low", "high")
    same = _same("s", "r", ["frame", "amount_min", "amount_max"])
    return framed.alias("s").join(told.alias("r"), same).select("s.query_id", "r.statements", "r.matched", "r.net")
