"""MinHash near-dedup with b-bit signatures; links are confirmed on full shingle sets.

1. One pass over the texts gives each a 128-bit fingerprint of its shingle set, ``BANDS`` band
   keys of ``ROWS`` minima each, and the low two bits of all 140 minima packed into five longs.
   At similarity 0.8 a pair shares no band with probability 1.5e-5.
2. Texts with equal sets become one class, represented by its smallest id.
3. Every class is paired with the ``LEADERS`` leaders of each of its band buckets (the smallest
   id, and the smallest by hashes that are the same for all buckets), never with all members.
   Pairs whose signatures are too far apart are set aside: bits agree by chance a quarter of the
   time, so similarity 0.8 means 0.85 agreement, and the limit lies five standard deviations below
   that.  The closest leader of each class is confirmed on full sets; links make components.
4. What is left to try are pairs of one bucket that lie in different components.  The members
   outside a bucket's largest component (strays) meet its other components inside tasks, in
   blocks of bounded size: first by signatures alone, then, where these are close, by full sets.
   Tasks return one link for two components that meet, not pairs.  A bucket that is one component
   costs nothing, and no pair that shares a band and could join two components stays untried,
   whatever the size of its bucket.

Shuffled per text are its keys (two passes over 28 longs); texts move once, to the ids that share
a bucket with another.  Joins on hot keys have written tables on both sides, so that adaptive
execution can split them.

Defined cases: null and empty texts have an empty set and no link.  Texts with fewer words than a
shingle have one shingle, the whole sequence.  Rows with a null id are returned unlinked
(component null, kept true).  Rows repeated under one id are one document: with different texts
it links to what any of them links to.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_jobs.llm.common import blocks, id_text, keep, record_batch, small_batches, whole_runs
from ledger_jobs.llm.components import components
from ledger_jobs.llm.words import Words, by_row, grams, mix

BANDS, ROWS, LEADERS = 28, 5, 4
#: Strays and members that meet in one bucket.
STRAYS, MEMBERS = 500, 2000
HASHES, LONGS = BANDS * ROWS, 5
U = np.uint64
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**64, HASHES, dtype=np.uint64) | U(1)
_B = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, in order of row and hash."""
    words = Words(texts, lower=True)
    h, counts = words.hashes(), words.counts
    rows, found = [], []
    row = np.repeat(np.arange(len(texts)), counts)
    if len(h) >= size:
        at = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
        rows.append(row[at])
        found.append(grams(h, size)[at])
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows.append(short)
            found.append(mix(grams(h, n)[words.first[short]] + U(n)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, h = np.concatenate(rows), np.concatenate(found)
    order = by_row(row, h)
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


SIGNED = pa.schema(
    [("id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
     ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))]
)


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            n = batch.num_rows
            row, h = shingle_sets(batch.column("text"), size)
            counts = np.bincount(row, minlength=n)
            full = np.flatnonzero(counts)
            starts = np.concatenate(([0], np.cumsum(counts)))[full]
            f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            keys, bits = np.zeros((n, BANDS), np.uint64), np.zeros((n, LONGS), np.uint64)
            if len(full):
                f1[full], f2[full] = np.add.reduceat(mix(h), starts), np.bitwise_xor.reduceat(mix(h + U(1)), starts)
                for k in range(HASHES):
                    least = np.minimum.reduceat(h * _A[k] + _B[k], starts)
                    keys[full, k // ROWS] = mix(keys[full, k // ROWS] + least + U(k))
                    bits[full, k // 32] |= (mix(least) & U(3)) << U(2 * (k % 32))
            as_list = lambda x: pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.view(np.int64).ravel())
            )
            yield record_batch(
                SIGNED, id=batch.column("id"), n_shingles=counts, f1=f1.view(np.int64), f2=f2.view(np.int64),
                bands=as_list(keys), bits=as_list(bits),
            )

    return run


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """id, n_shingles, fingerprint of the set (f1, f2), band keys and packed low bits of each text."""
    return id_text(df, id_col, text_col).mapInArrow(
        _signed(size), "id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, bits array<bigint>"
    )


def agreement(x: Column, y: Column) -> Column:
    """How many of the hashes have equal low bits."""
    differ = [_differ(x[i], y[i]) for i in range(LONGS)]
    return F.lit(HASHES) - reduce(add, differ)


def _differ(x: Column, y: Column) -> Column:
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def least_agreement(percent: int) -> int:
    """Agreeing hashes below which a pair of this similarity is five standard deviations away."""
    p = percent / 100 + (1 - percent / 100) / 4
    return math.floor(HASHES * p - 5 * math.sqrt(HASHES * p * (1 - p)))


def similarity(agree: Column) -> Column:
    """Estimate of the Jaccard similarity, corrected for bits that agree by chance."""
    return (agree / HASHES - 0.25) / 0.75


def _confirmed(size: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text_a", 2 << 20):
            n = batch.num_rows
            (row_a, a), (row_b, b) = (shingle_sets(batch.column(c), size) for c in ("text_a", "text_b"))
            row, h = np.concatenate((row_a, row_b)), np.concatenate((a, b))
            order = by_row(row, h)
            row, h = row[order], h[order]
            both = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=n)
            union = np.bincount(row, minlength=n) - both
            linked = np.flatnonzero((100 * both >= percent * union) & (both > 0))
            if len(linked):
                at = pa.array(linked)
                yield record_batch(schema, a=batch.column("a").take(at), b=batch.column("b").take(at))

    return run


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the similarity."""
    return (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(_confirmed(size, percent), "a bigint, b bigint")
        .distinct()
    )


def main_components(sizes: DataFrame) -> DataFrame:
    """(key, main, n, n_stray) of the keys of (key, component, k) with several components: the
    largest one (by number, then by component), all rows and those outside it."""
    wide = "decimal(38,0)"  # a long does not hold both; unlike structs, decimals aggregate by hash
    order = (F.col("k").cast("decimal(17,0)") * F.lit(Decimal(10**20))).cast(wide) + F.col("component")
    found = sizes.groupBy("key").agg(F.max_by("component", order.cast(wide)).alias("main"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("n_stray"))
    return found.filter("n_stray > 0")


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (key, id, component, main, n, n_stray) dealt into buckets in which strays (role 0, not
    in the main component of their key) meet members (role 1); keys with many of either are
    several buckets."""
    hash_, n_stray, n = F.xxhash64("id"), F.ceil(F.col("n_stray") / STRAYS), F.ceil(F.col("n") / MEMBERS)
    strays = rows.filter("component <> main").select(
        "key", "id", "component", F.lit(0).alias("role"), F.pmod(hash_, n_stray).alias("x"), F.explode(F.sequence(F.lit(0), n - 1)).alias("y")
    )
    others = rows.select(
        "key", "id", "component", F.lit(1).alias("role"), F.pmod(hash_, n).alias("y"), F.explode(F.sequence(F.lit(0), n_stray - 1)).alias("x")
    )
    return strays.unionByName(others).withColumn("bucket", F.xxhash64("key", "x", "y")).drop("x", "y")


def _close(batch: pa.RecordBatch, percent: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bucket of a batch: its rows, its strays and members by row, and which of them are
    of different components with signatures and sizes that allow the similarity."""
    bucket, role, group, n = (np.asarray(batch.column(c)) for c in ("bucket", "role", "component", "n_shingles"))
    bits = np.asarray(batch.column("bits").flatten()).reshape(-1, LONGS).view(np.uint64)
    low, odd = U(0x5555555555555555), U(1)
    edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows = np.arange(start, stop)
        stray, member = rows[role[rows] == 0], rows[role[rows] == 1]
        for at in range(0, len(stray), 64):
            s = stray[at : at + 64]
            x = bits[s][:, None] ^ bits[member][None]
            agree = HASHES - np.bitwise_count((x | (x >> odd)) & low).sum(-1, dtype=np.int64)
            small, large = np.minimum.outer(n[s], n[member]), np.maximum.outer(n[s], n[member])
            yield s, member, (agree >= least_agreement(percent)) & (small * 100 >= large * percent) & (group[s][:, None] != group[member][None])


def _active(percent: int):
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, "bucket", 5000):
            rows = [x for s, m, close in _close(batch, percent) for x in (s[close.any(1)], m[close.any(0)])]
            at = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
            if len(at):
                yield record_batch(schema, key=batch.column("key").take(pa.array(at)), id=batch.column("id").take(pa.array(at)))

    return run


def _bridges(size: int, percent: int):
    """Links of strays to other components, one for each two of them in a bucket; a pair that
    shares several keys is compared under the first of its bands."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, "bucket", 2000):
            key, ids, group, n = (np.asarray(batch.column(c)) for c in ("key", "id", "component", "n_shingles"))
            bands = np.asarray(batch.column("bands").flatten()).reshape(-1, BANDS)
            row, h = shingle_sets(batch.column("text"), size)
            begin = np.searchsorted(row, np.arange(batch.num_rows + 1))
            a, b = [], []
            for s, m, close in _close(batch, percent):
                for i, may in zip(s.tolist(), close, strict=True):
                    j = m[may]
                    j = j[bands[i][(bands[j] == bands[i]).argmax(1)] == key[i]]
                    if not len(j):
                        continue
                    mine = h[begin[i] : begin[i + 1]]
                    length = begin[j + 1] - begin[j]
                    stop = np.cumsum(length)
                    theirs = h[np.arange(stop[-1]) + np.repeat(begin[j] - (stop - length), length)]
                    found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                    both = np.add.reduceat(found, stop - length, dtype=np.int64)
                    j = j[100 * both >= percent * (n[i] + n[j] - both)]
                    j = j[np.unique(group[j], return_index=True)[1]]
                    a += [int(ids[i])] * len(j)
                    b += ids[j].tolist()
            if a:
                yield record_batch(schema, a=a, b=b)

    return run


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component, kept.

    Links are pairs with 100 * intersection >= percent * union of their sets of ``size``-word
    shingles, for ``percent`` of 80 or more; ``kept`` marks the smallest id of each component.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = keep(signatures(df, id_col, text_col, size), "minhash-signatures")
    full = signed.filter("id IS NOT NULL AND n_shingles > 0")
    classes = keep(full.groupBy("f1", "f2").agg(F.min("id").alias("head")), "minhash-classes")
    heads = keep(
        full.join(classes, ["f1", "f2"]).filter("id = head").select("id", "n_shingles", "bands", "bits"), "minhash-heads"
    )
    buckets = heads.select("id", F.explode("bands").alias("key"))
    picks = [F.min("id"), *[F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(1, LEADERS)]]
    shared = keep(
        buckets.groupBy("key").agg(F.array_distinct(F.array(*picks)).alias("leaders"), F.max("id").alias("high"), F.min("id").alias("low"))
        .filter("high > low").select("key", "leaders"),
        "minhash-buckets",
    )
    members = keep(buckets.join(shared, "key"), "minhash-members")
    texts = keep(id_text(df, id_col, text_col).join(members.select("id").distinct(), "id"), "minhash-texts")

    def promising(pairs: DataFrame) -> DataFrame:
        x, y = (heads.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
        agree = agreement(F.col("bits_a"), F.col("bits_b"))
        alike = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        near = pairs.join(x, "a").join(y, "b").filter(alike & (agree >= least_agreement(percent)))
        return keep(near.select("a", "b", agree.cast("long").alias("agree")).distinct(), "minhash-pairs")

    def best(pairs: DataFrame, *by: str) -> DataFrame:
        order = F.col("agree") * (1 << 44) + F.pmod("b", F.lit(1 << 44))
        found = pairs.groupBy(*by).agg(F.max_by("b", order).alias("b_"), F.max_by("a", order).alias("a_"))
        return keep(found.select(F.col("a_").alias("a"), F.col("b_").alias("b")), "minhash-best")

    stars = promising(members.select(F.col("id").alias("a"), F.explode("leaders").alias("b")).filter("a <> b").distinct())
    links = keep(confirm(best(stars, "a"), texts, size, percent), "minhash-links")
    groups = keep(components(links), "minhash-components")

    placed = keep(
        members.select("key", "id").join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")),
        "minhash-placed",
    )
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("k"))
    mixed = keep(main_components(sizes), "minhash-mixed")
    light = heads.select("id", "n_shingles", "bits")
    active = keep(
        meetings(placed.join(mixed, "key"), percent).join(light, "id").repartition(parts, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_active(percent), "key bigint, id bigint").distinct(),
        "minhash-active",
    )
    if not active.isEmpty():
        rows = active.join(placed, ["key", "id"]).join(mixed, "key")
        full_rows = meetings(rows, percent).join(heads, "id").join(texts, "id")
        more = full_rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_bridges(size, percent), "a bigint, b bigint")
        links = links.unionByName(keep(more.distinct(), "minhash-links"))
        groups = keep(components(links), "minhash-components")

    named = keep(
        classes.join(groups.withColumnRenamed("id", "head"), "head", "left").select("f1", "f2", F.coalesce("component", "head").alias("component")),
        "minhash-named",
    )
    light = signed.select("id", "n_shingles", "f1", "f2")
    linked = light.filter("id IS NOT NULL AND n_shingles > 0").join(named, ["f1", "f2"]).select("id", "n_shingles", "component")
    alone = light.filter("id IS NULL OR n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def without_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``df``, with all their columns, of which the smallest of each group stays.

    Rows, not ids, are compared: of several rows of one id, one goes by the id and the others by a
    hash of id and text, behind all ids below 2**62, so that each is judged by its own text (rows
    equal in both go together).
    Rows with a null id stay.
    """
    small_batches(df.sparkSession)
    mark = F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    given = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), mark.alias("mark")).filter("id IS NOT NULL")
    repeated = keep(
        given.groupBy("id").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).filter("first < last").select("id", "first"), "minhash-repeated"
    )
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), mark.alias("mark"))
    late = F.shiftrightunsigned("mark", 2).bitwiseOR(F.lit(1 << 62))  # behind the ids of a table
    own = F.when(F.col("first").isNull() | (F.col("mark") == F.col("first")), F.col("id")).otherwise(late)
    rows = rows.join(repeated, "id", "left").select("row", own.alias("id"))
    groups = near_groups(rows.select("id", F.col("row").getField(text_col).alias("text")), "id", "text", size, percent)
    gone = keep(groups.filter("NOT kept").select("id").distinct(), "minhash-gone")
    return rows.join(gone, "id", "left_anti").select("row.*")
