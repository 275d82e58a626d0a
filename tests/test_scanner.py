"""The scanner of lines against the column expressions and against plain statements of the rules."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from ledger_jobs.functions import dates
from ledger_jobs.operators import scanner, wording

D = dt.date
LINES = [
    "", " ", "on 99/99/2023 or 9 Feb 2023 or 1/1/2020", "paid 2023-02-09 late", "2023-02-09T10:00 x", "x9 Feb 2023", "9-FEB-23 shop", "Feb 9, 2023 shop", "feb 9 2023", "09.02.23", "09.02.2023", "02/19/2023", "9/2/81", "31/04/2024 30/04/2024",
    "5 feb 12 mar 3 2023", "a_9/2/23", "é9/2/23", "9/2/1989", "20/2/2101", "March\t9,  2024", "1 sept 2024", "29 feb 2023", "9\xa0Feb 2023", "12/11/10/09", "1-2-3", "tuesday 12 12 2012",
    "é 9 Feb shop", "FEB 9,100.00", "Feb 30", "the 9th feb x", "Oct 5th", "oct 5.50", "5 octopus", "12:5 Oct", "5 OCT,7", "may 1 may 2", "1st  jan",
]


def test_dates_as_expressions_have_them(spark):
    rnd = random.Random(4)
    bits = ["9", "31", "2024", "feb", "March", "/", "-", ".", " ", "  ", ",", "x", "th", "7,50", "T", "é", "23", "12"]
    lines = LINES + ["".join(rnd.choice(bits) for _ in range(rnd.randint(3, 9))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, line string").select("k", dates.find_date_span(F.col("line")).alias("full"), dates.find_yearless_span(F.col("line"), F.lit(2023)).alias("short")).orderBy("k").collect()
    found = scanner.Lines(lines)
    span = lambda s: s and (s.date, s.start, s.stop)
    assert [x for x in zip(lines, found.dates(), (span(r.full) for r in rows), strict=True) if x[1] != x[2]] == []
    short = found.yearless([2023] * len(lines), [None] * len(lines))
    assert [x for x in zip(lines, short, (span(r.short) for r in rows), strict=True) if x[1] != x[2]] == []


def test_days_behind_the_statement():
    found = scanner.Lines(["28 dec x", "5 jan x", "29 feb x"])
    assert [x[0] for x in found.yearless([2024] * 3, [D(2024, 1, 31)] * 3)] == [D(2023, 12, 28), D(2024, 1, 5), D(2024, 2, 29)]


def test_wording_and_places():
    lines = ["  BALANCE BROUGHT  FORWARD 1,000.00", "Closing balance on 3 May", "total paid in 5.00", "Totals : 4.00", "Overdraft limit", "Page 3", "clear", "aeration", "sort  code 1", "\xa0 x", "b/f 3.00", ""]
    got = scanner.said(lines, [None] * len(lines), 2024)
    take = lambda c: got[c].to_pylist()
    assert take("summary") == [True, True, True, True] + [False] * 8
    assert take("noise") == [False] * 4 + [True, True, False, False, True, False, False, False]
    assert take("opening_end") == [26, None, None, None, None, None, None, None, None, None, 3, None]
    assert take("indent") == [2, 0, 0, 0, 0, 0, 0, 0, 0, 2, 0, 0]
    assert take("text_plain")[:4] == ["BALANCE BROUGHT FORWARD", "Closing balance on 3 May", "total paid in", "Totals :"]


def test_phrases_against_patterns():
    rnd = random.Random(7)
    tables = ((wording.SUMMARY, scanner.SUMMARY), (wording.OPENING, scanner.OPENING), (wording.NOISE, scanner.NOISE))
    bits = sorted({w for table, _ in tables for p in table for w in p.strip("*").split(" ")} | {"x", "_", "7", "é", "forwarded", "12", ":", "a"})
    lines = ["".join(rnd.choice(bits) + rnd.choice((" ", " ", " ", "  ", "\t", "", "x", ".")) for _ in range(rnd.randint(1, 6))) for _ in range(4000)]
    # pairs of words that belong together, so that phrases occur often
    lines += [rnd.choice(("", "x", " ", "9 ")) + p.strip("*").replace("#", "3").replace(" ", rnd.choice((" ", " \t", ""))) + rnd.choice(("", "s", " x", "_", "/")) for table, _ in tables for p in table for _ in range(20)]
    for table, words in tables:
        one = lambda p: ("" if p.startswith("*") else r"\b") + re.escape(p.strip("*")).replace(r"\ ", r"[ \t]+").replace(r"\#", "[0-9]") + ("" if p.endswith("*") else r"\b")
        pattern = re.compile("|".join(map(one, sorted(table, key=len))))
        expected = [m.span() if (m := pattern.search(x)) else None for x in lines]
        assert sum(e is not None for e in expected) > 100
        assert [x for x, e in zip(lines, expected, strict=True) if words.find(x) != e or words.said(x) != bool(e)] == []
        assert scanner.Lines(lines).ends(words).tolist() == [e[1] if e else -1 for e in expected]


def test_headers():
    lines = ["Date   Details   Paid out   Paid in   Balance", "Date Details Money out Money in", "date amount 5.00 balance", "Amount    Balance", "Amount Date", "credits  debits balance", "undated"]
    got = scanner.said(lines, [None] * len(lines), 2024)["header"].to_pylist()
    assert got[0] == {"placed": True, "out": {"start": 17, "stop": 25}, "in": {"start": 28, "stop": 35}, "amount": None, "balance": {"start": 38, "stop": 45}, "date": {"start": 0, "stop": 4}}
    assert got[1] == {"placed": False, "out": None, "in": None, "amount": None, "balance": None, "date": None}
    assert [bool(x) for x in got] == [True, True, False, True, False, True, False] and got[3]["placed"] and got[5]["out"]["start"] == 9


def test_whole_texts():
    got = scanner.about(["a 1.00\nb 2.00 3.00\n\nc", "", "5 May 2024\n1 May 2024 2.50\n9 May 2024", "x\n" * 5 + "7.00"], 2)
    assert got["figure_lines"].to_pylist() == [2, 0, 1, 1] and got["period_end"].to_pylist() == [None, None, D(2024, 5, 5), None]
