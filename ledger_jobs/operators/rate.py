"""Fixed-window rate limit per key.

A window opens at a key's first request and the next one at the first request after it has ended,
so where windows lie depends on all earlier requests and no time grid gives them.  Requests are
sorted within keys after one shuffle; a task goes through its sorted rows batch by batch and keeps
two numbers for the key at hand, so a key of any size is a stream, not a group in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_starts(keys: np.ndarray, times: np.ndarray, window: int, goes_on: bool = False, last_start: int = 0) -> np.ndarray:
    """Start of the window of each row, for rows sorted by key and time; with ``goes_on`` the first
    key is one whose last window opened at ``last_start``."""
    out = np.empty(len(times), np.int64)
    i, n = 0, len(times)
    bounds = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, n)
    for stop in bounds.tolist():
        start = last_start if goes_on and i == 0 else None
        while i < stop:
            if start is None or times[i] - start >= window:
                start = int(times[i])
            end = i + int(np.searchsorted(times[i:stop], start + window, side="left"))
            out[i:end] = start
            i = end
    return out


def rate_limit(requests: DataFrame, key: str, ts: str, window: int, most: int, order: str) -> DataFrame:
    """``key, order, ts, window_start, n, allowed``: the how-manieth request of its window each is,
    and whether the limit allows it.  Requests over the limit count too."""
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(order).alias("id"), F.col(ts).cast("long").alias("ts"))
    schema = pa.schema([("key", pa.string()), ("id", pa.int64()), ("ts", pa.int64()), ("window_start", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_start, seen, any_yet = None, 0, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "ts"))
            goes_on = any_yet and keys[0] == last_key  # a null key is a key like others
            starts = window_starts(keys, times, window, goes_on, last_start)
            new = np.ones(len(starts), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1])
            new[0] = not goes_on or starts[0] != last_start
            first = np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
            n = np.arange(len(starts)) - first + 1
            if not new[0]:
                n[: int(np.argmax(new)) if new.any() else len(n)] += seen
            last_key, last_start, seen, any_yet = keys[-1], int(starts[-1]), int(n[-1]), True
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), batch.column("ts"), pa.array(starts), pa.array(n)], schema=schema)

    counted = (
        rows.repartition("key").sortWithinPartitions("key", "ts", "id")
        .mapInArrow(run, "key string, id bigint, ts bigint, window_start bigint, n bigint")
    )
    return counted.withColumn("allowed", F.col("n") <= most)
