"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a join-free regrouping of the links (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every node points its larger neighbours, then its smaller ones and
itself, at the smallest neighbour it knows.  A few rounds leave stars around the smallest id of
each component.  Links of one batch are contracted before they are shuffled.  Links are written to the shared folder after each round; no link, label or
component is ever gathered on the driver, only the number of links and a checksum of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_jobs.llm.common import keep, record_batch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a > b in, links of the same form out.

    A node meets its smallest neighbour by a join with the written minima rather than in a
    window, so that a node with very many neighbours can be split over tasks.
    """
    both = links.select("a", "b")
    if large:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = keep(both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low")), "star-minima")
    joined = both.join(low, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b"))
        )
    return out.filter("a <> b").distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as stars around the smallest id of what they connect."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, at = np.unique(np.concatenate([np.asarray(batch.column(c)) for c in ("a", "b")]), return_inverse=True)
        a, b = at[: batch.num_rows], at[batch.num_rows :]
        low = np.arange(len(ids))
        while True:
            least = np.minimum(low[a], low[b])
            new = low.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            np.minimum.at(new, low[a], least)
            np.minimum.at(new, low[b], least)
            new = new[new]
            if (new == low).all():
                break
            low = new
        other = np.flatnonzero(low != np.arange(len(ids)))
        yield record_batch(schema, a=ids[other], b=ids[low[other]])


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has a link to another; component is the smallest id
    reachable.  Links to itself, repeated links and nulls are ignored."""
    ids = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    now = keep(ids.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).mapInArrow(_contract, "a bigint, b bigint").distinct(), "links")
    state = _state(now)
    while True:
        now = keep(_star(keep(_star(now, True), "large-star"), False), "small-star")
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
