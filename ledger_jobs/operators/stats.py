"""Statistics of transactions: both sides and the whole in one aggregation.

Transactions have ``doc_id, txn_seq, block_no, source, line_no, date, time_sec, ts, description,
amount, direction, balance, raw``.  Money is summed as decimals, so that totals do not depend on
the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_jobs.functions.formats import duration_between
from ledger_jobs.functions.money import fmt_money, round2


def exact_sum(x: Column) -> Column:
    return F.sum(x.cast("decimal(20,4)"))


def side_aggregates(side: str) -> list[Column]:
    """Aggregates over the rows of one direction, with the side as prefix; only partial sums are
    shuffled."""
    mine = F.col("direction") == side
    amount, date = F.when(mine, F.col("amount")), F.when(mine, F.col("date"))
    return [
        exact_sum(amount).alias(f"{side}_exact"),
        F.count(amount).alias(f"{side}_count"),
        F.coalesce(F.min(amount), F.lit(0.0)).alias(f"{side}_min"),
        F.coalesce(F.max(amount), F.lit(0.0)).alias(f"{side}_max"),
        F.min(date).alias(f"{side}_first"),
        F.max(date).alias(f"{side}_last"),
    ]


def summarise(txns: DataFrame, *keys: str) -> DataFrame:
    """One row per key: for each side total, count, average, min, max, first and last date and
    duration, and over both the count, the net amount, the dates and the duration."""
    both = [F.count("*").alias("matched"), F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    grouped = txns.groupBy(*keys).agg(*side_aggregates("debit"), *side_aggregates("credit"), *both)
    out = grouped
    for side in ("debit", "credit"):
        count, exact = F.col(f"{side}_count"), F.col(f"{side}_exact")
        out = out.withColumns(
            {
                f"{side}_total": F.coalesce(exact.cast("double"), F.lit(0.0)),
                f"{side}_average": F.when(count > 0, round2(exact / count).cast("double")).otherwise(0.0),
                f"{side}_duration": duration_between(F.col(f"{side}_first"), F.col(f"{side}_last")),
            }
        )
    rounded = {f"{s}_{k}": round2(F.col(f"{s}_{k}")) for s in ("debit", "credit") for k in ("total", "min", "max")}
    net = round2(F.col("credit_total") - F.col("debit_total"))
    out = out.withColumns({"net": net} | rounded | {"duration": duration_between(F.col("first_date"), F.col("last_date"))})
    return out.drop("debit_exact", "credit_exact")


def formatted(summary: DataFrame, symbol: Column) -> DataFrame:
    """With totals and net as text in a currency."""
    names = {"debit_text": "debit_total", "credit_text": "credit_total", "net_text": "net"}
    return summary.withColumns({k: fmt_money(symbol, F.col(v)) for k, v in names.items()})


def with_empty(summary: DataFrame, docs: DataFrame, *keys: str) -> DataFrame:
    """A row of zeros and a warning for each of ``docs`` without transactions."""
    joined = docs.join(summary, list(keys), "left")
    zero = {c: F.coalesce(c, F.lit(0).cast(t)) for c, t in summary.dtypes if c not in keys and t in ("bigint", "double")}
    warning = F.when(F.col("matched").isNull(), F.array(F.lit("No transactions could be parsed from this file."))).otherwise(
        F.array().cast("array<string>")
    )
    return joined.withColumn("warnings", warning).withColumns(zero)
