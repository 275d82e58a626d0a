"""Column expressions on spelled-out cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledger_jobs.functions import dates, formats, money, text, web
from ledger_jobs.operators import columns, currency, rate, search, trail


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_money(spark):
    cases = {
        "-7.05": -7.05, "$ -1,007.05": -1007.05, "–€7.05": -7.05, "7.05 -": -7.05, "( 7.05 )": -7.05, "dr 7.05": -7.05, "7.05od": -7.05, "7.05food": 7.05, "7.05 od": -7.05, "refund − 7.05": -7.05,
        "7.05": 7.05, "KSh 41,900": 41900.0, "41.900,5": 41900.5, "cr 7.05": 7.05, "3,9": 3.9, "8.125": 8125.0, "8.125.000": 8125000.0, "44,100,200": 44100200.0,
        "": None, "none": None, "7-8": None, "4000000000000": None, "6.": 6.0, None: None, "99999999999999.5": None,
    }
    got = values(spark, list(cases), lambda c: money.parse_amount(c).value)
    assert dict(zip(cases, got, strict=True)) == cases


def test_amounts_in_line(spark):
    lines = ["tea 3.40 card 7654321", "card 9876543210 only", "till 55012 hut", "14 Feb 2023", "9,876.54 then 0.35 over"]
    got = values(spark, lines, lambda c: F.transform(money.find_amounts(c), lambda x: x.money.value))
    assert got == [[3.4], [], [55012.0], [], [9876.54, 0.35]]


def test_strict_amounts(spark):
    lines = ["a £1,234.50 b -£3.00  (4.10)", "5.00% 6.00/7 x8.00 9.001 1.2.30", "10.00 DR 11.00DRX 12.00-", "é 0.50", "none"]
    got = values(spark, lines, lambda c: F.transform(columns.strict_amounts(c), lambda a: F.struct(a.value, a.negative, a.start, a.stop)))
    assert [[tuple(x) for x in g] for g in got] == [
        [(1234.5, False, 3, 11), (3.0, True, 16, 20), (4.1, True, 23, 27)], [], [(10.0, True, 0, 5), (11.0, False, 9, 14), (12.0, True, 18, 23)], [(0.5, False, 2, 6)], []
    ]


def test_dates(spark):
    d = dt.date(2023, 2, 9)
    cases = {
        "2023-02-09": d, "2023/2/9": d, "09/02/2023": d, "9-2-2023": d, "09.02.2023": d, "09/02/23": d, "9 Feb 2023": d, "9-Feb-23": d, "9 february 2023": d, "February 9, 2023": d,
        "20230209": d, "09/02/2023 07:15": d, "2023-02-09T07:15:00Z": d, " 09/02/2023 ": d, "02/19/2023": dt.date(2023, 2, 19), "30/02/2023": None, "9/2/98": dt.date(1998, 2, 9),
        "9/2/81": None, "1988-02-09": None, "2101-01-01": None, "2023-02/09": None, "tuesday": None, "": None, None: None, "9 Feb": None,
    }
    assert dict(zip(cases, values(spark, list(cases), dates.parse_date), strict=True)) == cases
    assert values(spark, ["from 24:30 to 8:05", "by 8:05", "never"], dates.find_time) == [None, 8 * 3600 + 300, None]


def test_dates_in_lines(spark):
    lines = ["on 99/99/2023 or 9 Feb 2023 or 1/1/2020", "paid 2023-02-09 late", "no date 12"]
    spans = values(spark, lines, dates.find_date_span)
    assert [s and (s.date, s.start, s.stop) for s in spans] == [(dt.date(2023, 2, 9), 17, 27), (dt.date(2023, 2, 9), 5, 15), None]
    assert values(spark, lines, dates.find_date) == [s and s.date for s in spans]
    short = values(spark, ["é 9 Feb shop", "FEB 9,100.00", "Feb 30", "the 9th feb x"], lambda c: dates.find_yearless_span(c, F.lit(2023)))
    assert [s and (s.date, s.start, s.stop) for s in short] == [(dt.date(2023, 2, 9), 2, 7), None, None, (dt.date(2023, 2, 9), 4, 11)]


def test_duration(spark):
    row = spark.sql("SELECT DATE'2023-11-20' a, DATE'2025-01-19' b").select(formats.duration_between(F.col("a"), F.col("b")).alias("d")).first().d
    assert (row.days, row.weeks, row.months, row.years, row.human) == (426, 60, 13, 1, "1 year 1 month")


def test_wording(spark):
    assert values(spark, ["TOFFEE stall", "SODEN LANE", "board income", "CPT x", "dep y"], lambda c: text.classify_text(c, F.lit(False))) == ["debit", "credit", "credit", "debit", "credit"]
    assert values(spark, ["a\xa0 b ", "\t"], text.clean) == ["a b", ""]
    assert values(spark, ["https://www.www.x.org/a?b", "", "t.co/x", "y.com?q"], web.referrer_host) == ["x.org", "direct", "t.co", "y.com"]
    assert values(spark, ["a/b\\c.csv", "c.csv"], web.base_name) == ["c.csv", "c.csv"]
    assert values(spark, ["9.9.9.9, 10.0.0.1", " "], lambda c: web.client_ip(c, F.lit("8.8.8.8"))) == ["9.9.9.9", "8.8.8.8"]


def test_sample_of_currency(spark):
    rows = spark.createDataFrame([("a", 0, "€ " * 10), ("a", currency.SAMPLE_BYTES - 4, "$1 £££"), ("b", currency.SAMPLE_BYTES, "€"), ("c", 0, "sort code C$ cad")], "doc_id string, at bigint, text string")
    got = {r.doc_id: (r.code, r.confidence) for r in currency.detect(rows).collect()}
    assert got["b"] == ("UNKNOWN", 0.0) and got["a"] == ("EUR", 0.91)
    assert got["c"] == ("CAD", 0.63)


def test_windows_of_null_keys():
    keys = np.array([None, None, "a", "a"], object)
    assert rate.window_starts(keys, np.array([5, 12, 3, 30]), 10).tolist() == [5, 5, 3, 30]
    assert rate.window_starts(keys[:2], np.array([12, 16]), 10, True, 5).tolist() == [5, 16]


def test_signs():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 7):
        amounts, credit = rng.integers(1, 30, (50, k)), rng.random((50, k)) < 0.5
        deltas = np.where(rng.random(50) < 0.7, np.where(rng.random((50, k)) < 0.5, amounts, -amounts).sum(1), 1000)
        signs, found = trail.best_signs(amounts, credit, deltas)
        for a, c, d, s, ok in zip(amounts, credit, deltas, signs, found, strict=True):
            tried = [[(m >> i) & 1 == 1 for i in range(k)] for m in range(1 << k)]
            right = [t for t in tried if sum(x if y else -x for x, y in zip(a, t, strict=True)) == d]
            assert ok == bool(right)
            if right:
                assert s.tolist() == min(right, key=lambda t: sum(x != y for x, y in zip(t, c, strict=True)))


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("what did we pay for bread last month", {"keyword": "bread", "direction": "debit", "date_from": dt.date(2023, 7, 1), "date_to": dt.date(2023, 7, 31)}),
        ("7k to 9k", {"amount_min": 7000.0, "amount_max": 9000.0, "keyword": ""}),
        ("on 17-06-2023", {"amount_min": 6.0, "amount_max": 17.0, "date_from": dt.date(2023, 6, 17)}),
        ("museum an hour or so before I paid ilse 4k, between 100 and 250", {"keyword": "museum", "amount_min": 100.0, "amount_max": 250.0}),
        ("about 200", {"amount_min": 170.0, "amount_max": 230.0, "anchor": None}),
        ("", {"keyword": "", "human": "all transactions", "smart": False}),
    ],
)
def test_search(spark, query, expected):
    row = search.interpret(spark.createDataFrame([(1, query)], "query_id int, text string").withColumn("as_of", F.lit("2023-08-20").cast("date"))).first()
    for name, value in expected.items():
        assert row[name] == (pytest.approx(value) if isinstance(value, float) else value), (name, row)
    if "ilse" in query:
        assert (row.anchor.keyword, row.anchor.amount, row.anchor.after, row.anchor.around) == ("ilse", 4000.0, False, False)
