"""Exact dedup over an extendible-hash index on shared files, in DataFrame operations only.

1. Every row gets a 64-bit key of its normalised text; keys are counted (partial sums first) and
   the counts are written.
2. The directory: buckets are key ranges, given by a prefix of the key.  A bucket with more than
   ``bucket_keys`` distinct keys is split, which doubles the directory when its prefix is as long
   as the directory is deep; the depth grows until no bucket is overfull.  Copies of one text share
   a key and so do not overfill a bucket; they form its chain.  The directory has at most
   2**``MOST_DEPTH`` rows, whatever the corpus, so it can be broadcast; beyond that buckets hold
   more keys and nothing else changes.
3. Each task owns a range of buckets.  Rows go to their owner once, with their texts.  A chain of
   more than a quarter of a task's fair share of rows is cut into segments by a hash of the id, and
   these go to the owner and the tasks after it; there are at most four such chains per task.
4. An owner sorts its rows by (key, id) and compares every entry of a chain, byte by byte, with the
   chain's head, the smallest id.  What it finds is written; nothing is dealt again but the heads
   of segments and entries that differ from their head although their keys agree: these few are
   grouped by their whole texts.

Defined cases: a null text is empty.  Empty texts are equal to each other, and differ from a text
of white space only, which becomes one space.  Rows with a null id are returned with
keep_id null, group_size 1 and kept true, and are compared with nothing.  A row given several
times under one id is returned as often, counts as often in group_size, and is kept with its id;
``without_copies`` keeps one row of each group, repeated ids or not.  Extra columns are ignored by
the one and carried by the other.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_jobs.llm.common import SPACE_CLASS, id_text, keep, small_batches

BUCKET_KEYS, MOST_DEPTH = 4096, 18
#: Rows up to which a chain is never cut.
SEGMENT_ROWS = 1000
CHAIN = ["owner", "key", "segment"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS, " ")


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth)


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, most_depth: int = MOST_DEPTH) -> tuple[DataFrame, int]:
    """(prefix, bucket) for every prefix in use, and the directory's depth, of distinct (key).

    ``bucket`` is the first prefix of the bucket's range, and so orders buckets by key range.
    """
    deep = max(2, math.ceil(math.log2(keys.count() / bucket_keys + 1)) + 2)
    while True:
        # counts of all prefixes of up to ``deep`` bits; overfull ones are split while there are bits
        deep = min(deep, most_depth)
        counts = keep(keys.groupBy(_prefix(F.col("key"), deep).alias("prefix")).agg(F.count("*").alias("n")), "hash-prefixes")
        nodes = counts.select("prefix", "n", F.explode(F.sequence(F.lit(0), F.lit(deep))).alias("d"))
        nodes = nodes.withColumn("node", F.expr(f"shiftright(prefix, {deep} - d)"))
        sizes = nodes.groupBy("d", "node").agg(F.sum("n").alias("keys"))
        deepest = sizes.filter(F.col("keys") > bucket_keys).agg(F.max("d")).first()[0]
        if deepest is None or deepest < deep or deep == most_depth:
            break
        deep += 4
    depth = min(deep, 1 if deepest is None else deepest + 1)
    fits = sizes.filter((F.col("d") >= 1) & ((F.col("keys") <= bucket_keys) | (F.col("d") == depth)))
    local = nodes.join(fits, ["d", "node"]).groupBy("prefix").agg(F.min("d").alias("local"))
    table = local.select(
        F.shiftright("prefix", deep - depth).alias("prefix"),
        F.expr(f"shiftleft(shiftright(prefix, {deep} - local), {depth} - local)").alias("bucket"),
    )
    return keep(table.distinct(), "hash-directory"), depth


def _chains(rows: DataFrame, norm: Column, bucket_keys: int, most_depth: int) -> DataFrame:
    """Rows (id, key, body) in their owner tasks, with bucket, segment, whether the chain is ``cut``
    into segments, their ``place`` in the chain, its smallest id ``low``, their text ``norm`` and
    whether it is ``equal`` to the head's."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = keep(rows.groupBy("key").agg(F.count("*").alias("n")), "hash-keys")
    table, depth = directory(keys, bucket_keys, most_depth)
    most = max(SEGMENT_ROWS, (keys.agg(F.sum("n")).first()[0] or 0) // (4 * parts))
    hot = keys.filter(F.col("n") > most).select("key", F.ceil(F.col("n") / most).alias("segments"))
    dealt = rows.withColumn("prefix", _prefix(F.col("key"), depth)).join(F.broadcast(table), "prefix").join(F.broadcast(hot), "key", "left")
    segment = F.coalesce(F.pmod(F.xxhash64("id"), F.col("segments")), F.lit(0)).cast("int")
    owner = F.pmod(F.shiftright(F.col("bucket") * parts, depth) + segment, F.lit(parts)).cast("int")
    dealt = dealt.select("id", "key", "body", "bucket", segment.alias("segment"), F.col("segments").isNotNull().alias("cut"), owner.alias("owner"))
    upto = Window.partitionBy(*CHAIN).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = dealt.repartitionById(parts, "owner").withColumn("norm", norm)
    found = {"place": F.row_number().over(upto), "low": F.first("id").over(upto), "head": F.first("norm").over(upto)}
    return owned.withColumns(found).withColumn("equal", F.col("norm") == F.col("head")).drop("head")


def build_index(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, most_depth: int = MOST_DEPTH
) -> DataFrame:
    """The index on shared files: bucket, key, segment, cut, place, id, low, digest of each row, how
    many of its segment ``equal`` the head, and the text where it must be looked at again: of
    heads of segments and of entries that differ from their head (``apart``)."""
    texts = id_text(df, id_col, text_col).filter("id IS NOT NULL").select("id", normalised(F.col("text")).alias("body"))
    rows = _chains(texts.select("id", F.xxhash64("body").alias("key"), "body"), F.col("body"), bucket_keys, most_depth)
    again = F.when(~F.col("equal") | (F.col("cut") & (F.col("place") == 1)), F.col("norm"))
    rows = rows.select("bucket", *CHAIN, "cut", "place", "id", "low", "equal", F.sha2("norm", 256).alias("digest"), again.alias("again"))
    rows = rows.withColumn("n", F.count_if("equal").over(Window.partitionBy(*CHAIN)))
    return keep(rows.withColumn("apart", ~F.col("equal")).drop("owner", "equal"), "hash-index")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, digest (SHA-256 of the
    normalised text)."""
    entries = build_index(df, id_col, text_col, **index)
    place = F.when(F.col("apart"), F.col("place")).otherwise(1)
    parts = entries.filter("again IS NOT NULL").select("key", "segment", place.alias("place"), "id", F.when(F.col("apart"), 1).otherwise(F.col("n")).alias("n"), "again")
    groups = parts.groupBy("key", "again").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))
    settled = keep(parts.join(groups, ["key", "again"]).select("key", "segment", "place", "keep_id", "group_size"), "hash-settled")
    open_ = F.col("cut") | F.col("apart")
    plain = entries.filter(~open_).select("id", F.col("low").alias("keep_id"), F.col("n").alias("group_size"), "digest")
    rest = entries.filter(open_).withColumn("place", place).join(settled, ["key", "segment", "place"])
    alone = id_text(df, id_col, text_col).filter("id IS NULL")
    alone = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.sha2(normalised(F.col("text")), 256).alias("digest"))
    out = plain.unionByName(rest.select(*plain.columns)).unionByName(alone)
    return out.select("id", "keep_id", "group_size", F.coalesce(F.col("keep_id") == F.col("id"), F.lit(True)).alias("kept"), "digest")


def without_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, most_depth: int = MOST_DEPTH
) -> DataFrame:
    """The rows of ``df``, with all their columns, without copies: of equal texts one row of the
    smallest id stays.  Rows with a null id stay."""
    small_batches(df.sparkSession)
    norm = lambda c: normalised(F.coalesce(c.cast("string"), F.lit("")))
    body = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(norm(F.col(f"`{text_col}`"))).alias("key"), body.alias("body"))
    chains = _chains(rows, norm(F.col("body").getField(text_col)), bucket_keys, most_depth)
    again = F.when(~F.col("equal") | F.col("cut"), F.col("norm"))
    firsts = keep(chains.filter(~F.col("equal") | (F.col("place") == 1)).select("key", "segment", "place", "id", "body", again.alias("again")), "hash-firsts")
    best = F.row_number().over(Window.partitionBy("key", "again").orderBy("id", "segment", "place"))
    settled = firsts.filter("again IS NOT NULL").withColumn("best", best).filter("best = 1").select("body")
    kept = firsts.filter("again IS NULL").select("body").unionByName(settled)
    return kept.select("body.*").unionByName(df.filter(F.col(f"`{id_col}`").isNull()))
