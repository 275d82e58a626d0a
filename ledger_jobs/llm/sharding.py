"""Sharding by a permutation-filled lookup table, in DataFrame operations only.

Every shard has its own order of preference over the slots of a table of prime size (a start and
a step from digests of its name).  Shards take turns, each claiming its next free slot, until the
table is full: shares differ by one slot at most, and when a shard comes or goes few other slots
change hands.  The table has ``slots`` rows whatever the data, so it is broadcast, and a row is
placed by one hash and one lookup, without a shuffle.

Defined cases: a null key is placed like the empty string; equal keys go to one shard, so a key
that very many rows share should be joined by a second column (``key_cols`` takes several).
Writing splits each shard over ``files`` tasks by a hash of the row, hot or not.  An empty table
gives an empty result.  Other columns pass through unless they are named slot or shard, which
are replaced (they may be key columns all the same).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preferences(shard: str, slots: int) -> tuple[int, int]:
    """Start and step of a shard's order over the slots; any step below a prime visits all."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """Number of the shard that holds each slot."""
    if slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} slots: a prime is needed")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, one at least and no more than slots")
    at_step = [preferences(s, slots) for s in shards]
    table, turn = [-1] * slots, 0
    at = [start for start, _ in at_step]
    for _ in range(slots):
        slot = at[turn]
        while table[slot] >= 0:
            slot = (slot + at_step[turn][1]) % slots
        table[slot] = turn
        at[turn] = (slot + at_step[turn][1]) % slots
        turn = (turn + 1) % len(shards)
    return table


def slot_of(key_cols: list[str], slots: int) -> Column:
    """Slot of a row: 60 bits of the MD5 of its key columns, modulo the table's size."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    return (F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key_cols: list[str], shards: list[str], slots: int = 65_537) -> DataFrame:
    """``df`` with the slot and the shard of each row."""
    rows = [(slot, shards[k]) for slot, k in enumerate(lookup_table(shards, slots))]
    table = df.sparkSession.createDataFrame(rows, "slot int, shard string")
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    return df.select(*others, slot_of([f"`{c}`" for c in key_cols], slots).alias("slot")).join(F.broadcast(table), "slot")


def write_shards(placed: DataFrame, path: str, files: int = 1) -> None:
    """One folder per shard, each written by ``files`` tasks."""
    spread = F.pmod(F.xxhash64(*[c for c in placed.columns if c not in ("slot", "shard")]), F.lit(files))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)
