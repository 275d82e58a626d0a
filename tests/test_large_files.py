"""Files read by ranges have the cells of files read whole."""

import random

from pyspark.sql import functions as F

from ledger_jobs.plans import statements
from ledger_jobs.sources import files, large_files, records


def texts():
    rnd = random.Random(2)
    line = lambda k, mark: mark.join([f"2024-01-{k % 28 + 1:02d}", f'"shop, {rnd.randint(1, 999)}; ""x"""', f"{rnd.uniform(1, 900):.2f}", rnd.choice(["", "é", "a b"])])
    made = {}
    for name, mark in (("a b+c%20.csv", ","), ("b.csv", ";"), ("c.tsv", "\t"), ("d.csv", "|")):
        rows = [mark.join(("Date", "Details", "Amount", "Note"))] + [line(k, mark) if k % 50 else rnd.choice(["", " ", "ragged"]) for k in range(1500)]
        made[name] = ("\r\n" if name == "b.csv" else "\n").join(rows)
    made["a b+c%20.csv"] = "\ufeff" + made["a b+c%20.csv"]
    made["over.csv"] = made["d.csv"].replace("|", ",") + '\n2024-01-01,"two\nlines",3.00,x\n'
    return made


def test_ranges_equal_whole(spark, tmp_path):
    for name, text in texts().items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "latin.csv").write_bytes("Date,Details,Amount\n2024-01-01,café,3.00\n".encode("latin-1"))
    (tmp_path / "small.csv").write_bytes(b"Date,Details,Amount\n2024-01-01,tea,3.00\n")
    paths = sorted(r.doc_id for r in large_files.listed(spark, str(tmp_path), 45).collect())
    assert len(paths) == 5  # not latin.csv and small.csv, which are small
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        got, others = large_files.cells(spark, [*paths, f"file:{tmp_path}/latin.csv"])
        scan = spark.read.text(paths)
        assert scan.rdd.getNumPartitions() > 3 * len(paths)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(p.rpartition("/")[2] for p in others) == ["latin.csv", "over.csv"]
    name = F.element_at(F.split("doc_id", "/"), -1)
    listed = lambda df: sorted((r.name, r.line_no, r["at"], r.cells, r.warning) for r in df.select(name.alias("name"), "line_no", "at", "cells", "warning").collect())
    whole, _ = records.table_cells(files.kinds(files.decode(files.expand(files.load(spark, str(tmp_path))))))
    assert listed(got) == listed(whole.filter(name.isin("a b+c%20.csv", "b.csv", "c.tsv", "d.csv")))


def test_statements_of_large_files(spark, tmp_path):
    for file, text in texts().items():
        (tmp_path / file).write_bytes(text.encode())
    (tmp_path / "small.csv").write_bytes(b"Date,Details,Amount\n2024-01-01,tea,3.00\n")

    def shown(found):
        name = F.element_at(F.split("doc_id", "/"), -1).alias("name")
        txns = found.txns.select(name, "txn_seq", "date", "description", "amount", "direction").collect()
        return sorted(map(tuple, txns), key=str), sorted(map(str, found.files.select(name, "kind", "size_bytes", "parts", "warnings").collect())), sorted(map(str, found.currencies.drop("doc_id").collect()))

    want = shown(statements.read_and_parse(spark, str(tmp_path), 2024))
    assert len(want[0]) > 5000 and shown(statements.read_and_parse(spark, str(tmp_path), 2024, large_bytes=1000)) == want
