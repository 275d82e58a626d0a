"""Request logs as streams: cleaning, daily counts, rate limits, appended tables.

Event time is a column; rows later than the watermark are dropped, earlier ones merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledger_jobs.operators import traffic
from ledger_jobs.sources import log_tables


def cleaned_visits(stream: DataFrame, places: DataFrame, salt: str) -> DataFrame:
    """Visits joined to a static table of places, cleaned, without addresses."""
    return traffic.clean_visits(traffic.enrich_places(stream, places, F.col("country_header"), F.col("ip")), salt)


def cleaned_analyses(stream: DataFrame, places: DataFrame, salt: str) -> DataFrame:
    """Analyses joined to a static table of places, cleaned, without addresses."""
    return traffic.clean_analyses(traffic.enrich_places(stream, places, F.col("country_header"), F.col("ip")), salt)


def cleaned_feedback(stream: DataFrame) -> DataFrame:
    """Feedback within its limits, without rows that say nothing."""
    return traffic.clean_feedback(stream)


def daily_counts(stream: DataFrame, ts: str = "event_time", late: str = "1 day") -> DataFrame:
    """Rows and about how many visitors per UTC day, final once the watermark has passed."""
    day = F.window(ts, "1 day")
    counts = stream.withWatermark(ts, late).groupBy(day.alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("visitor").alias("visitors"))
    return counts.select(F.to_date("w.start").alias("day"), "n", "visitors")


class FixedWindow(StatefulProcessor):
    """Window start and count of a key.  A timer in event time forgets a key ``keep`` seconds after its
    last request: by then its window is over, so whoever comes back starts a new one either way, and a
    replay of the stream expires the same keys at the same rows."""

    def __init__(self, window: int, most: int, keep: int):
        self.window, self.most, self.keep = window, most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "start bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.state.get() if self.state.exists() else (None, 0)
        # a trigger's requests of one key, in order; one that is older than the open window counts in it
        batch = pd.concat(list(rows)).sort_values(["ts", "id"])
        out = []
        for ts, id_ in zip(batch["ts"].tolist(), batch["id"].tolist(), strict=True):
            if start is None or ts - start >= self.window:
                start, n = ts, 0
            n += 1
            out.append((key[0], id_, ts, start, n, n <= self.most))
        self.state.update((start, n))
        forget = (max(start, out[-1][2]) + self.keep) * 1000
        for timer in list(self.handle.listTimers()):
            if timer < forget:
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(forget)
        yield pd.DataFrame(out, columns=["key", "id", "ts", "window_start", "n", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit(stream: DataFrame, window: int, most: int, late: str = "1 hour") -> DataFrame:
    """Streams of (key, id, ts) with the number of each request in its window and whether it is
    allowed.  Requests more than ``late`` behind the newest are dropped, as are those of 1970 (the
    first watermark) and before; a key is forgotten two windows after its last request, once the
    watermark is there."""
    schema = "key string, id bigint, ts bigint, window_start bigint, n bigint, allowed boolean"
    timed = stream.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", late)
    return timed.groupBy("key").transformWithStateInPandas(FixedWindow(window, most, 2 * window), schema, "Update", "EventTime")


def append(stream: DataFrame, table: str, name: str, checkpoint: str):
    """Appends a stream to a table of logs (``logs.append``), each batch once: a batch that is tried
    again after a crash replaces what its first try has written."""

    def put(rows: DataFrame, batch: int) -> None:
        log_tables.append(rows, table, f"{name}-{batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
