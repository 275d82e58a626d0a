"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from ledger_jobs.operators import rate, traffic
from ledger_jobs.plans import logs
from ledger_jobs.sources import log_tables
from ledger_jobs.streaming import streams


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", i, 10_000 + i * 7 + (i % 5)) for i in range(200)]
    data = spark.createDataFrame(rows, "key string, id bigint, ts bigint")
    for part in range(2):
        data.filter(F.floor(F.col("id") / 100) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in rate.rate_limit(data, "key", "ts", 60, 3, "id").select("id", "window_start", "n", "allowed").collect()}
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    query = streams.rate_limit(stream, 60, 3).writeStream.outputMode("update").format("memory").queryName("limited").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("limited").select("id", "window_start", "n", "allowed").collect()} == want


def test_daily_counts(spark, tmp_path):
    rows = [(f"v{i % 4}", f"2024-01-0{1 + i % 3} 10:00:00") for i in range(30)]
    data = spark.createDataFrame(rows, "visitor string, t string").select("visitor", F.col("t").cast("timestamp").alias("event_time"))
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.daily_counts(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert sorted((str(r.day), r.n) for r in spark.table("daily").collect()) == [("2024-01-01", 10), ("2024-01-02", 10), ("2024-01-03", 10)]


DAY = 86_400
RAW = {
    "visits": "id bigint, ts bigint, visitor string, ip string, country_header string, path string, referrer string, user_agent string",
    "analyses": "id bigint, ts bigint, visitor string, ip string, country_header string, file_kind string, size_bytes bigint, scanned bigint, matched bigint, currency string",
    "feedback": "id bigint, ts bigint, visitor string, country string, stars int, would_pay string, review string, price string",
}


def raw_logs(spark):
    start = 19_700 * DAY
    visits = [(k, start + k * DAY // 2, f" v-{k}!", ("10.0.0.1", "8.8.8.8", "9.9.9.9")[k % 3], (None, "XX", "Peru")[k % 3], "/p", "https://www.a.org/x", "Mozilla Firefox") for k in range(12)]
    analyses = [(k, start + k * DAY // 2, "v", "8.8.8.8", None, "csv", 10 * k, k, None, None) for k in range(12)]
    feedback = [(1, start, "v", "Peru", 9, "YES", " good ", None), (2, start, "v", "Peru", 0, "", " ", None), (3, start, None, None, None, None, None, None)]
    return {n: spark.createDataFrame(r, RAW[n]) for n, r in (("visits", visits), ("analyses", analyses), ("feedback", feedback))}


def test_logs_by_day_and_retention(spark, tmp_path, monkeypatch):
    places = spark.createDataFrame([("8.8.8.8", "Chile", "r", "c")], "ip string, country string, region string, city string")
    cleaned = logs.clean(raw_logs(spark), places, "salt")
    path = str(tmp_path / "logs")
    logs.append(cleaned, path, "run-1")
    logs.append(cleaned, path, "run-1")  # again, as after a crash
    visits = logs.stored(spark, path, "visits")
    assert visits.count() == 12
    assert sorted({(r.country, r.visitor[:2], r.referrer, r.device) for r in visits.collect()}) == [(c, "v-", "a.org", "Desktop · Firefox") for c in ("Chile", "Local", "Peru")]
    assert [(r.stars, r.would_pay, r.review) for r in logs.stored(spark, path, "feedback").collect()] == [(5, "yes", "good")]
    now, want = 19_700 * DAY + 6 * DAY + 600, [19_700 * DAY + k * DAY // 2 for k in range(9, 12)]  # within the day of rows 8 and 9
    with monkeypatch.context() as broken:
        broken.setattr(log_tables, "drop_expired", lambda *_: 1 / 0)
        for name in logs.EXPIRING:
            with pytest.raises(ZeroDivisionError):  # a crash before anything is deleted
                log_tables.expire(spark, f"{path}/{name}", now - 2 * DAY)
            assert sorted(r.ts for r in logs.stored(spark, path, name).collect()) == want
    logs.prune(spark, path, 2, now)
    logs.prune(spark, path, 3, now)  # a limit never moves back
    for name in logs.EXPIRING:
        assert sorted(r.ts for r in logs.stored(spark, path, name).collect()) == want
        assert sorted(p.name for p in (tmp_path / "logs" / name).glob("day=*")) == ["day=2023-12-13", "day=2023-12-14"]
    logs.append({"visits": cleaned["visits"].limit(0)}, path, "run-2")
    assert logs.stored(spark, path, "visits").count() == 3 and logs.stored(spark, path, "feedback").count() == 1


def test_log_streams_equal_batches(spark, tmp_path):
    raw = raw_logs(spark)
    places = spark.createDataFrame([("8.8.8.8", "Chile", "r", "c")], "ip string, country string, region string, city string")
    for name, rows in raw.items():
        rows.repartition(2).write.parquet(str(tmp_path / "in" / name))
    live = logs.clean({n: spark.readStream.schema(RAW[n]).parquet(str(tmp_path / "in" / n)) for n in RAW}, places, "salt")
    for name, stream in live.items():
        streams.append(stream, str(tmp_path / "out" / name), "live", str(tmp_path / "cp" / name)).awaitTermination(120)
    for name, batch in logs.clean(raw, places, "salt").items():
        got = log_tables.read(spark, str(tmp_path / "out" / name)).select(*batch.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect())), name


def test_batch_tried_again_is_in_the_table_once(spark, tmp_path, monkeypatch):
    """The query dies after a batch is written and before it is committed, and starts again."""
    rows = spark.range(40).select("id", (F.lit(19_700 * DAY) + F.col("id") * 7_000).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id bigint, ts bigint").parquet(str(tmp_path / "in"))
    table, write = str(tmp_path / "out"), log_tables.append

    def dies(*args):
        write(*args)
        raise RuntimeError("gone")

    monkeypatch.setattr(log_tables, "append", dies)
    with pytest.raises(Exception, match="gone"):
        streams.append(source(), table, "live", str(tmp_path / "cp")).awaitTermination(120)
    assert log_tables.read(spark, table).count() == 40
    monkeypatch.setattr(log_tables, "append", write)
    streams.append(source(), table, "live", str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.id for r in log_tables.read(spark, table).collect()) == list(range(40))


def test_keys_expire_in_event_time(spark, tmp_path):
    """A key is forgotten once the watermark is two windows past it, rows behind the watermark are
    dropped, and a query that starts again goes on counting."""
    batches = [
        [("a", 1, 1000), ("a", 2, 1010), ("b", 3, 1020)],
        [("a", 4, 1030)],  # after a restart: the third of its window
        [("c", 5, 5000)],  # the watermark moves to 4990
        [("a", 6, 900), ("d", 7, 5001)],  # behind the watermark
        [("a", 8, 5020), ("c", 9, 5021)],
    ]
    got, kept = [], []

    def put(rows, _):
        got.extend(tuple(r) for r in rows.select("key", "id", "window_start", "n").collect())

    for batch in batches:
        spark.createDataFrame(batch, "key string, id bigint, ts bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, id bigint, ts bigint").parquet(str(tmp_path / "in"))
        query = streams.rate_limit(stream, 60, 3, "10 seconds").writeStream.outputMode("update").foreachBatch(put).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.awaitTermination(120)
        kept.append(query.lastProgress.stateOperators[0].numRowsTotal)
    assert sorted(got, key=lambda r: r[1]) == [("a", 1, 1000, 1), ("a", 2, 1000, 2), ("b", 3, 1000 + 20, 1), ("a", 4, 1000, 3), ("c", 5, 5000, 1), ("d", 7, 5001, 1), ("a", 8, 5020, 1), ("c", 9, 5000, 2)]
    assert kept == [2, 2, 1, 2, 3]  # a and b went when c moved the watermark


def test_sketches_merge_over_days_and_batches(spark, tmp_path):
    """Counts from stored sketches lie within four standard errors, however batches cut the days."""
    rows = spark.range(200_000).select(
        "id", (F.lit(19_700 * DAY) + F.col("id") % (3 * DAY)).alias("ts"), F.concat(F.lit("v"), (F.col("id") * 7919 % 60_000).cast("string")).alias("visitor"),
        F.concat(F.lit("a"), (F.col("id") % 9).cast("string")).alias("ip_hash"), F.when(F.col("id") % 5 == 0, "Peru").otherwise("Chile").alias("country"),
    )
    for part in range(3):
        logs.append_sketches({"visits": rows.filter(F.col("id") % 3 == part)}, str(tmp_path), f"run-{part}")
    logs.append_sketches({"visits": rows.filter("id % 3 = 1")}, str(tmp_path), "run-1")  # again
    stored = logs.stored(spark, str(tmp_path), "visit_sketches")
    error = 4 * 1.04 / 2 ** (traffic.SKETCH / 2)
    for keys in ((), ("country",), ("day",), ("day", "country")):
        dated = rows.withColumn("day", F.to_date(F.timestamp_seconds("ts")))
        want = {tuple(r[k] for k in keys): r for r in dated.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("visitor").alias("visitors"), F.count_distinct("ip_hash").alias("ips")).collect()}
        got = {tuple(r[k] for k in keys): r for r in traffic.from_sketches(stored, *keys).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert r.n == want[k].n and r.ips == want[k].ips and abs(r.visitors - want[k].visitors) <= error * want[k].visitors
