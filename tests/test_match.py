"""Searches that are broadcast and searches that are filed under keys give the same rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ledger_jobs.operators import match, search, search_index, search_totals, stats
from ledger_jobs.plans import statements

TEXTS = ["everything in january after rent", "everything after rent", "everything before rent", "everything in march after rent", "shop", "", "everything in february", "everything after lottery"]


TXNS = "doc_id string, txn_seq bigint, block_no int, source string, line_no int, date date, time_sec int, ts timestamp_ntz, description string, amount double, direction string, balance double, raw string"


def test_filed_equals_broadcast(spark, monkeypatch):
    days = [(2023, 12, 31, 22, "rent"), (2024, 1, 1, 9, "shop"), (2024, 1, 20, 9, "shop"), (2024, 2, 3, 8, "cash"), (2024, 3, 1, 23, "rent"), (2024, 3, 2, 7, "shop")]
    rows = [
        ("d", k, 0, "s", k, dt.date(y, m, d), h * 3600, dt.datetime(y, m, d, h), text, 10.0 * (k + 1), "debit", None, text)
        for k, (y, m, d, h, text) in enumerate(days)
    ] + [("d", 9, 0, "s", 9, None, None, None, "shop", 5.0, "debit", None, "shop")]
    txns = spark.createDataFrame(rows, TXNS)
    asked = spark.createDataFrame(list(enumerate(TEXTS)), "query_id int, text string").withColumn("as_of", F.lit("2024-01-31").cast("date"))
    q = search.interpret(asked).cache()

    def found():
        m = match.matches(txns, q)
        listed = sorted((r.query_id, r.txn_seq) for r in m.collect())
        return listed, sorted((r.query_id, tuple(r.notices)) for r in match.notices(txns, q).collect())

    want = found()
    monkeypatch.setattr(match, "BROADCAST_ROWS", 0)
    assert [k for i, k in want[0] if i == 0] == [1] and len(want[1]) > 3
    assert found() == want


def some_txns(rnd):
    rows = []
    for k in range(400):
        day = rnd.choice([None, dt.date(2024, 1, 1) + dt.timedelta(rnd.randint(-500, 500)), dt.date(1969, 12, rnd.randint(1, 31))])
        clock = rnd.choice([None, rnd.randint(0, 86399)])
        stamp = None if day is None or clock is None else dt.datetime.combine(day, dt.time()) + dt.timedelta(seconds=clock)
        text = rnd.choice([None, "", "Rent paid", "coffee SHOP", "éclair ßtraße", "grocery shop coffee", "cafe 12"])
        rows.append((f"d{k % 7}", k, 0, "s", k, day, clock, stamp, text, rnd.choice([0.0, 0.01, 9.99, 50.0, 1234.5, 1e12, -3.0]), rnd.choice(["debit", "credit", None]), None, rnd.choice([text, "ref 12345 shop", None])))
    return rows


def some_searches(rnd, schema):
    rows = []
    for k in range(300):
        first = dt.date(2024, 1, 1) + dt.timedelta(rnd.randint(-500, 500))
        spans = [(None, None), (first, first + dt.timedelta(rnd.choice([0, 1, 6, 30, 365, 4000]))), (first, None), (first, first - dt.timedelta(1)), (dt.date(1969, 12, 3), dt.date(1970, 1, 2))]
        bands = [(None, None), (None, 50.0), (9.99, None), (0.01, 9.99), (50.0, 50.0), (9.0, 3.0), (-5.0, 0.0)]
        anchor = rnd.choice([None, None, ("coffee shop", 50.0, True, False, 48, None), ("", 9.0, False, False, 24, first), ("xy", None, False, True, 24, None), ("Rent", 1200.0, True, False, 24 * 30, None)])
        values = {
            "query_id": k, "text": "", "keyword": rnd.choice(["", "", "shop", "RENT", "o", "straße", "ref 12", "nothing like it", "cafe 12"]), "direction": rnd.choice([None, "debit", "credit"]),
            "hours": rnd.choice([[], [], [(20, 23), (0, 5)], [(5, 11)]]), "human": "", "smart": False, "as_of": first,
        }
        values |= dict(zip(("date_from", "date_to"), rnd.choice(spans), strict=True)) | dict(zip(("amount_min", "amount_max"), rnd.choice(bands), strict=True))
        names = ("keyword", "amount", "after", "around", "window_hours", "on_date")
        values["anchor"] = None if anchor is None else dict(zip(names, anchor, strict=True))
        rows.append(tuple(values[f.name] for f in schema))
    return rows


@pytest.mark.parametrize("automaton", [True, False])
def test_every_kind_of_search(spark, monkeypatch, automaton):
    rnd = random.Random(3)
    txns = spark.createDataFrame(some_txns(rnd), TXNS).repartition(3)
    schema = search.interpret(spark.createDataFrame([(1, "")], "query_id int, text string").withColumn("as_of", F.current_date())).schema
    q = spark.createDataFrame(some_searches(rnd, schema), schema)

    def found():
        anchors = match.resolve_anchors(txns, q).select("query_id", "doc_id", "anchor_txn.txn_seq").collect()
        return sorted((r.query_id, r.doc_id, r.txn_seq) for r in match.matches(txns, q).collect()), sorted(map(tuple, anchors))

    want = found()
    assert len(want[0]) > 2000 and len(want[1]) > 50
    monkeypatch.setattr(match, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(search_index, "AUTOMATON_BYTES", 1 << 20 if automaton else 0)
    assert found() == want
    plan = match.matches(txns, q)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cover_is_a_partition(spark):
    ranges = [(a, b) for a in (-9, -1, 0, 1, 5, 8, 1023, 19_000) for b in (-5, -1, 0, 7, 8, 9, 1024, 4095, 19_999)] + [(-(1 << 21), 1 << 21), (0, (1 << 22) - 1)]
    df = spark.createDataFrame(ranges, "a bigint, b bigint").select("a", "b", search_index.cover(F.col("a"), F.col("b"), 0).alias("cells"))
    for a, b, cells in df.collect():
        parts = sorted((c.cell << c.level, ((c.cell + 1) << c.level) - 1) for c in cells)
        assert (not parts) == (a > b) and len(parts) <= 2 * max(1, math.ceil(math.log2(max(2, b - a + 2))))
        if parts:
            assert parts[0][0] == a and parts[-1][1] == b and all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:], strict=False))


def test_sparse_results_hold_all(spark, tmp_path):
    rnd = random.Random(5)
    txns = spark.createDataFrame(some_txns(rnd), TXNS).repartition(3).cache()
    schema = search.interpret(spark.createDataFrame([(1, "")], "query_id int, text string").withColumn("as_of", F.current_date())).schema
    q = spark.createDataFrame(some_searches(rnd, schema)[:60], schema)
    files = spark.createDataFrame([(f"d{k}", "csv", 10, [], []) for k in range(9)], "doc_id string, kind string, size_bytes bigint, parts array<string>, warnings array<string>")
    coins = spark.createDataFrame([("d0", "£", "GBP", "British Pound", 1.0, "symbol")], "doc_id string, symbol string, code string, name string, confidence double, detected_by string")
    results = statements.sparse_results(statements.Statements(files, txns, coins), q)
    statements.write_sparse(results, str(tmp_path / "out"))
    stored = statements.read_sparse(spark, str(tmp_path / "out"))
    hits = {(r.query_id, r.doc_id) for r in match.matches(txns, q).select("query_id", "doc_id").distinct().collect()}
    anchors = {(r.query_id, r.doc_id) for r in match.resolve_anchors(txns, q).collect()}
    kept = [(r.query_id, r.doc_id) for r in stored.found.select("query_id", "doc_id").collect()]
    assert sorted(kept) == sorted(hits | anchors) and len(kept) < 60 * 9
    told = {(r.query_id, r.doc_id): r.notices for r in match.notices(txns, q, coins.select("doc_id", "symbol")).collect()}
    every = statements.spelled_out(stored).collect()
    assert len(every) == 60 * 9 and {(r.query_id, r.doc_id) for r in every if r.summary.matched} == hits
    assert all(r.warnings == told.get((r.query_id, r.doc_id), []) for r in every) and sum(bool(r.warnings) for r in every) > 50
    assert all((r.summary.matched, r.debit.total, r.matched, r.summary.scanned) == (0, 0.0, [], 0) for r in every if r.doc_id in ("d7", "d8"))


@pytest.mark.parametrize("most", [1, 3])
def test_cut_lists(spark, monkeypatch, most):
    """The list ends after ``most`` matches in statement order, and the result says so."""
    txns = spark.createDataFrame(some_txns(random.Random(6)), TXNS)
    q = search.interpret(spark.createDataFrame([(1, ""), (2, "shop")], "query_id int, text string").withColumn("as_of", F.lit("2024-01-31").cast("date")))
    found = match.matches(txns, q).cache()
    sequence = {}
    for r in found.orderBy("query_id", "doc_id", "txn_seq").collect():
        sequence.setdefault((r.query_id, r.doc_id), []).append(r.description)
    got = {}
    for r in match.matched_list(found, most).orderBy("query_id", "doc_id", "rank").collect():
        got.setdefault((r.query_id, r.doc_id), []).append((r["rank"], r.description))
    assert got == {k: list(enumerate(v[:most], 1)) for k, v in sequence.items()}
    monkeypatch.setattr(match, "MOST_MATCHES", most)
    assert {(r.query_id, r.doc_id): r.truncated for r in match.results(found, txns, q).collect()} == {k: len(v) > most for k, v in sequence.items()}


@pytest.mark.parametrize(("said", "want"), [("after rent", [4, 5]), ("before rent", [1, 2]), ("around rent within 12 hours", [1, 2, 4, 5])])
def test_windows_to_the_microsecond(spark, said, want):
    """Rows of the anchor's own second, and at the edges of the window, are told apart."""
    noon, wide = dt.datetime(2024, 1, 5, 12, 0, 0, 500_000), dt.timedelta(hours=12)
    tick = dt.timedelta(microseconds=1)
    stamps = [noon - wide - tick, noon - wide, noon - tick, noon, noon + tick, noon + wide, noon + wide + tick]
    rows = [("d", k, 0, "s", k, t.date(), t.hour * 3600 + t.minute * 60 + t.second, t, "rent" if t == noon else "shop", 5.0, "debit", None, "") for k, t in enumerate(stamps)]
    asked = spark.createDataFrame([(1, f"everything {said}")], "query_id int, text string").withColumn("as_of", F.lit("2024-01-31").cast("date"))
    found = match.matches(spark.createDataFrame(rows, TXNS), search.interpret(asked)).collect()
    assert sorted(r.txn_seq for r in found) == want


@pytest.mark.parametrize("few", [True, False])
def test_totals_are_those_of_pairs(spark, monkeypatch, few):
    rnd = random.Random(7)
    rows = [r if k % 9 else (*r[:9], None, *r[10:]) for k, r in enumerate(some_txns(rnd))]  # some without an amount
    txns = spark.createDataFrame(rows, TXNS).repartition(3)
    schema = search.interpret(spark.createDataFrame([(1, "")], "query_id int, text string").withColumn("as_of", F.current_date())).schema
    q = spark.createDataFrame(some_searches(rnd, schema), schema).withColumn("anchor", F.lit(None).cast(schema["anchor"].dataType)).cache()
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    pairs = match.matches(txns, q).groupBy("query_id").agg(F.count_distinct("doc_id"), F.count("*"), stats.exact_sum(signed))
    want = sorted(map(tuple, pairs.collect()))
    if not few:
        monkeypatch.setattr(match, "BROADCAST_ROWS", 0)
    got = sorted(map(tuple, search_totals.totals(txns, q).select("query_id", "statements", "matched", "net").collect()))
    assert len(want) > 100 and got == want and len({x[1] for x in want}) > 5
