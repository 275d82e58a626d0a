"""W3: request logs to cleaned tables by day, and their retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledger_jobs.operators import traffic
from ledger_jobs.sources import log_tables
from ledger_jobs.streaming import streams

#: Logs that expire; feedback is kept.
EXPIRING = ("visits", "analyses")


def clean(logs: dict[str, DataFrame], places: DataFrame, salt: str) -> dict[str, DataFrame]:
    """The three raw logs, batch or stream, as they are stored."""
    return {
        "visits": streams.cleaned_visits(logs["visits"], places, salt),
        "analyses": streams.cleaned_analyses(logs["analyses"], places, salt),
        "feedback": streams.cleaned_feedback(logs["feedback"]),
    }


def append(cleaned: dict[str, DataFrame], path: str, run: str) -> None:
    """Appends batches to the tables below a path; repeating a ``run`` changes nothing."""
    for name, rows in cleaned.items():
        log_tables.append(rows, f"{path}/{name}", run)


def append_sketches(cleaned: dict[str, DataFrame], path: str, run: str) -> None:
    """Sketches of a batch's visits beside the tables; those of all batches of a day are merged when read."""
    log_tables.append(traffic.sketches(cleaned["visits"]).drop("day"), f"{path}/visit_sketches", run)


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    return log_tables.read(spark, f"{path}/{name}")


def prune(spark: SparkSession, path: str, older_than_days: int, now: int) -> None:
    """Visits and analyses over so many days (one at least) before ``now`` (epoch seconds) expire."""
    for name in EXPIRING:
        log_tables.expire(spark, f"{path}/{name}", now - max(older_than_days, 1) * 86_400)
