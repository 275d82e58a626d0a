"""Visits, analyses and feedback: cleaning, places, totals, top lists, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_jobs.functions import web


def enrich_places(logs: DataFrame, places: DataFrame, header_country: Column, ip: Column) -> DataFrame:
    """Country, region and city of each row: the header's country, Local for private addresses,
    the table of places (ip, country, region, city), or Unknown.  The join is by address; it is
    left to the engine to broadcast a small table of places."""
    rows = logs.withColumns({"header_country": web.header_country(header_country), "ip": ip})
    known = places.select("ip", *[F.col(c).alias(f"place_{c}") for c in ("country", "region", "city")])
    by_header, local = F.col("header_country").isNotNull(), web.is_private(F.col("ip"))
    joined = rows.join(known, "ip", "left")
    country = F.when(by_header, F.col("header_country")).when(local, "Local").otherwise(F.coalesce("place_country", F.lit("Unknown")))
    rest = {c: F.when(by_header | local, "").otherwise(F.coalesce(f"place_{c}", F.lit(""))) for c in ("region", "city")}
    return joined.withColumns({"country": country} | rest).drop("header_country", "place_country", "place_region", "place_city")


def clean_visits(visits: DataFrame, salt: str) -> DataFrame:
    """Visits with visitor id, hashed address, device and referrer host; addresses do not stay."""
    return visits.select(
        "ts", web.clean_visitor(F.col("visitor")).alias("visitor"), web.hash_ip(F.col("ip"), salt).alias("ip_hash"), "country",
        web.clip(F.col("path"), 200).alias("path"), web.referrer_host(F.col("referrer")).alias("referrer"),
        web.device(F.col("user_agent")).alias("device"),
    )


def clean_analyses(analyses: DataFrame, salt: str) -> DataFrame:
    """Analyses with visitor id and hashed address; addresses do not stay."""
    figures = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size_bytes", "scanned", "matched")]
    return analyses.select(
        "ts", web.clean_visitor(F.col("visitor")).alias("visitor"), web.hash_ip(F.col("ip"), salt).alias("ip_hash"), "country", "region", "city",
        web.clip(F.coalesce("file_kind", F.lit("")), 40).alias("file_kind"), *figures, F.coalesce("currency", F.lit("")).alias("currency"),
    )


def clean_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback within its limits; rows that say nothing are left out."""
    rows = feedback.withColumns(
        {
            "stars": web.stars(F.coalesce("stars", F.lit(0))),
            "would_pay": web.would_pay(F.coalesce("would_pay", F.lit(""))),
            "review": web.clip(F.coalesce("review", F.lit("")), 2000),
            "price": web.clip(F.coalesce("price", F.lit("")), 60),
        }
    )
    return rows.filter((F.col("stars") > 0) | (F.col("would_pay") != "") | (F.col("review") != ""))


def totals(visits: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row: visits, visitors, addresses; analyses, analysing visitors, bytes, matched, scanned."""
    v = visits.agg(F.count("*").alias("visits"), F.count_distinct("visitor").alias("visitors"), F.count_distinct("ip_hash").alias("ips"))
    a = analyses.agg(
        F.count("*").alias("analyses"), F.count_distinct("visitor").alias("analysts"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("size_bytes", "matched", "scanned")],
    )
    return v.join(a, how="cross")


def by_country(logs: DataFrame, most: int = 50) -> DataFrame:
    """Rows and visitors of the countries with the most rows; ties by name."""
    grouped = logs.groupBy("country").agg(F.count("*").alias("n"), F.count_distinct("visitor").alias("visitors"))
    return grouped.orderBy(F.desc("n"), "country").limit(most)


def by_day(logs: DataFrame, most: int = 30) -> DataFrame:
    """Rows and visitors of the latest days (UTC)."""
    day = F.to_date(F.timestamp_seconds("ts")).alias("day")
    return logs.groupBy(day).agg(F.count("*").alias("n"), F.count_distinct("visitor").alias("visitors")).orderBy(F.desc("day")).limit(most)


def newest(logs: DataFrame, most: int, id_col: str = "id") -> DataFrame:
    """The newest rows with short visitor ids; a top-n, not a sort of the whole log."""
    return logs.orderBy(F.desc(id_col)).limit(most).withColumn("visitor", web.short_visitor(F.col("visitor")))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Count, average stars over rows with stars, and answers."""
    rated = F.when(F.col("stars") > 0, F.col("stars"))
    answers = [F.count_if(F.col("would_pay") == a).alias(a) for a in ("yes", "maybe", "no")]
    return feedback.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(rated), 2), F.lit(0.0)).alias("avg_stars"), *answers)


def shares(visits: DataFrame, analyses: DataFrame, feedback: DataFrame) -> DataFrame:
    """Percentages of the dashboard: analyses per visit, and each answer of all answers."""
    percent = lambda a, b: F.when(b > 0, F.round(a * 100.0 / b)).otherwise(0.0).cast("long")
    counts = totals(visits, analyses).select("visits", "analyses").join(feedback_summary(feedback), how="cross")
    answered = F.col("yes") + F.col("maybe") + F.col("no")
    return counts.select(
        percent(F.col("analyses"), F.col("visits")).alias("conversion"), *[percent(F.col(a), answered).alias(f"{a}_share") for a in ("yes", "maybe", "no")]
    )


def country_shares(logs: DataFrame, most: int = 50) -> DataFrame:
    """Each listed country's rows in percent of the largest."""
    top = by_country(logs, most)
    largest = logs.groupBy("country").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"))
    return top.join(largest, how="cross").withColumn("share", F.round(F.col("n") * 100.0 / F.col("largest")).cast("long")).drop("largest")


def retained(logs: DataFrame, older_than_days: int, now: Column) -> DataFrame:
    """Rows that are not older than so many days (one at least)."""
    return logs.filter(F.col("ts") >= now - max(older_than_days, 1) * 86_400)


#: Distinct counts from sketches of 2**SKETCH numbers: standard error 1.04 / 2**(SKETCH / 2), under one percent.
SKETCH = 14
SKETCHED = {"visitors": "visitor", "ips": "ip_hash"}


def sketches(logs: DataFrame) -> DataFrame:
    """Per UTC day and country the number of rows and mergeable sketches of visitors and addresses:
    some kilobytes each, whatever the log, to be stored so that counts over any days need no rescan."""
    day = F.to_date(F.timestamp_seconds("ts")).alias("day")
    counted = [F.hll_sketch_agg(c, SKETCH).alias(name) for name, c in SKETCHED.items()]
    return logs.groupBy(day, "country").agg(F.min("ts").alias("ts"), F.count("*").alias("n"), *counted)


def from_sketches(stored: DataFrame, *keys: str) -> DataFrame:
    """Rows, and about how many visitors and addresses, per ``keys`` (day, country, or none), of
    sketches of any days and batches."""
    merged = [F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in SKETCHED]
    return stored.groupBy(*keys).agg(F.sum("n").alias("n"), *merged)
