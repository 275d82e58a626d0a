"""Merkle manifest of a table: checkpoint every few levels, recompute the rest.

1. Leaves are hashed in place, written narrow, dealt in sorted ranges and numbered within their
   tree from the sizes of the ranges before, so that a tree of any size is spread over many tasks.
2. A level that is ``LEVELS`` higher is made from aligned subtrees of 2**``LEVELS`` nodes: a task
   gets a subtree's nodes, folds them and passes on the top.  Only these levels are written; the
   nodes between them are not.  The tops of all trees are the leaves of one further tree, which is
   built by the same functions.
3. Proofs go down: the nodes of a subtree meet the path from its top to the root.  The task makes
   the nodes between again from the stored ones, puts each leaf's siblings together and drops them.
   Stored paths are one per subtree, about ``2**-LEVELS`` of the leaves.

A digest is lowercase hex SHA-256; a field is its UTF-8 byte count, ``:`` and its value, or ``-``
if null.  Two nodes that follow each other make their parent; a last one without a neighbour is
hashed alone; one node on a level is the top.

Defined cases: null trees come first and are a tree of their own; null ids come first in theirs and
are never tampered with.  Repeated ids are ordered by leaf, and repeated rows are leaves of their
own.  Null and empty texts differ.  Extra columns are ignored.  An empty table has no rows, and no root.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_jobs.llm.common import keep, small_batches

#: Levels from one written level to the next.
LEVELS = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_ROWS = 4096
NODE = "tree string, n bigint, idx bigint, hash string"
PATH = "tree string, idx bigint, hash string, path string, root string"
TOP = "tree string, round int, hash string, path string, root string"
PROOF = "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (with ``tree``) with their place ``idx`` in their tree, which has ``n`` in all."""
    ordered = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ordered = keep(ordered.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "merkle-ordered")
    parts = Window.partitionBy("tree").orderBy("part")
    runs = ordered.groupBy("part", "tree").agg(F.min("row").alias("low"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", "tree", "low", before.alias("before"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return ordered.join(runs, ["part", "tree"]).withColumn("idx", F.col("before") + F.col("row") - F.col("low")).drop("part", "row", "low", "before")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    for some in batched(rows, _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)


def climb(hashes: list[str], n: int, levels: int) -> list[list[str]]:
    """All levels of a subtree, from its nodes to its top; ``n``: nodes of its tree on their level."""
    steps = levels if n > 1 << levels else (len(hashes) - 1).bit_length()
    out = [hashes]
    for _ in range(steps):
        low = out[-1]
        out.append([_sha("".join(low[i : i + 2])) for i in range(0, len(low), 2)])
    return out


def siblings(subtree: list[list[str]], place: int) -> list[tuple[str, str]]:
    """(side, digest) of the sibling on each level below the top; ``-`` for a node without one."""
    out = []
    for level in subtree[:-1]:
        other = place ^ 1
        out.append(("R" if other > place else "L", level[other]) if other < len(level) else ("-", ""))
        place >>= 1
    return out


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for side, other in path:
        digest = _sha(other + digest if side == "L" else digest + other)
    return digest


def as_text(path: list[tuple[str, str]]) -> str:
    return "".join(side + other for side, other in path)


def from_text(path: str) -> list[tuple[str, str]]:
    return [(m[1] or "-", m[2] or "") for m in re.finditer("([LR])([0-9a-f]{64})|-", path)]


def rise(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes ``levels`` higher, or the tops of trees that end before that (their n is 1)."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (tree, block), group in groupby(_rows(batches), key=lambda r: r[:2]):
                hashes, sizes = zip(*((r[3], r[4]) for r in group), strict=True)
                yield tree, -(-sizes[0] >> levels), block, climb(list(hashes), sizes[0], levels)[-1][0]

        return _batches(rows(), NODE)

    dealt = nodes.select("tree", F.shiftright("idx", levels).alias("block"), "idx", "hash", "n")
    return dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx").mapInArrow(tops, NODE)


def build(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """(written levels, tops): nodes of every ``levels``-th level, without trees that ended below,
    and (tree, round, hash) of every tree's top; ``round``: the written level under its top."""
    stored, tops = [nodes], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        up = keep(rise(stored[-1], levels), "merkle-level")
        tops.append(up.filter("n = 1").select("tree", F.lit(len(stored) - 1).alias("round"), "hash"))
        most = -(-most >> levels)
        if most <= 1:
            return stored, reduce(DataFrame.unionByName, tops)
        stored.append(up.filter("n > 1"))


def extract(nodes: DataFrame, paths: DataFrame, levels: int, emit: Callable[[tuple, list, list], Iterator[tuple]], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """What ``emit`` makes of each subtree: of its row of ``paths`` (as ``PATH``, idx counting
    subtrees), its nodes (tree, block, idx, hash, n and ``extra``), and all its levels."""

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, group in groupby(_rows(batches), key=lambda r: r[:2]):
                tree, block, _, hash_, _, path, root = next(group)[:7]
                held = [(*r[:5], *r[7:]) for r in group]
                yield from emit((tree, block, hash_, path, root), held, climb([r[3] for r in held], held[0][4], levels))

        return _batches(rows(), schema)

    mine = nodes.select("tree", F.shiftright("idx", levels).alias("block"), "idx", "hash", "n", *extra)
    above = paths.select("tree", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), "hash", "path", "root")
    both = mine.unionByName(above, allowMissingColumns=True).select("tree", "block", "idx", "hash", "n", "path", "root", *extra)
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx").mapInArrow(below, schema)


def _paths(top: tuple, nodes: list[tuple], subtree: list[list[str]]) -> Iterator[tuple]:
    """Paths of inner nodes, with the hash of their tree's top."""
    for place, (tree, _, idx, *_) in enumerate(nodes):
        yield tree, idx, top[2], as_text(siblings(subtree, place)) + top[3], top[4]


def _tops(top: tuple, nodes: list[tuple], subtree: list[list[str]]) -> Iterator[tuple]:
    """Paths of the tops of trees in the tree of tops."""
    for place, (_, _, _, hash_, _, of, round_) in enumerate(nodes):
        yield of, round_, hash_, as_text(siblings(subtree, place)) + top[3], top[4]


def _proofs(top: tuple, nodes: list[tuple], subtree: list[list[str]]) -> Iterator[tuple]:
    """Digest of each leaf's proof, and the root that it gives with the leaf that is held against it."""
    above = from_text(top[3])
    rest, folded = "".join(other for _, other in above), {}
    for place, (_, _, _, hash_, _, id_, tampered) in enumerate(nodes):
        path = siblings(subtree, place)
        reached = fold(tampered or hash_, path)
        if reached not in folded:
            folded[reached] = fold(reached, above)
        yield id_, hash_, top[2], top[4], _sha("".join(other for _, other in path) + rest), folded[reached]


def leaf_paths(stored: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """``PATH`` of every subtree of leaves, from ``TOP`` of every tree."""
    found = None
    for k in reversed(range(len(stored))):
        ended = tops.filter(F.col("round") == k).select("tree", F.lit(0).cast("long").alias("idx"), "hash", "path", "root")
        found = ended if found is None else found.unionByName(ended)
        if k:
            found = keep(extract(stored[k], found, levels, _paths, PATH), "merkle-paths")
    return found


def proofs(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``PROOF`` of each leaf (tree, id, hash, tampered, tie); ``tampered``: a digest to hold against
    the leaf's siblings instead of its own, or null."""
    small_batches(leaves.sparkSession)
    nodes = keep(numbered(leaves, ["id", "hash", "tie"]), "merkle-leaves")
    stored, tops = build(nodes, levels)
    over = keep(numbered(tops.withColumn("of", F.col("tree")).withColumn("tree", F.lit("")), ["of"]), "merkle-tops")
    stored_over, root = build(over, levels)
    root = keep(root.select("tree", "round", "hash", F.lit("").alias("path"), F.col("hash").alias("root")), "merkle-root")
    tops = keep(extract(over, leaf_paths(stored_over, root, levels), levels, _tops, TOP, ("of", "round")), "merkle-subroots")
    return extract(nodes, leaf_paths(stored, tops, levels), levels, _proofs, PROOF, ("id", "tampered"))


def leaves(df: DataFrame, fields: list[str], tree_col: str, id_col: str, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One narrow row per row of ``df``, written: tree, id, hash, tie, and ``tampered``: the leaf
    with other values in some fields, for the rows that ``where`` names."""
    small_batches(df.sparkSession)
    values = {c: F.col(f"`{c}`") for c in fields}
    other = F.lit(None).cast("string") if where is None else F.when(where, leaf(list((values | (tampered or {})).values())))
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))  # null first
    return keep(
        df.select(tree.alias("tree"), F.col(f"`{id_col}`").cast("long").alias("id"), leaf(list(values.values())).alias("hash"), other.alias("tampered"), F.monotonically_increasing_id().alias("tie")),
        "merkle-hashed",
    )


def manifest(df: DataFrame, every: int = 7, levels: int = LEVELS) -> DataFrame:
    """Proofs of the rows of a table of documents, each checked against the root: where ``every``
    divides the CRC-32 of an id, with n_chars one larger."""
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    found = proofs(leaves(df, FIELDS, "lang", "doc_id", more, hit), levels)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
