"""Large delimited files, read by many tasks each.

A file of one record per line is read by Spark's split text scan.  The place of a row in its file is
its place in its range of bytes plus the rows of the ranges before, so no task sees more than a range
and nothing orders a whole file.  Rows get the cells that ``records.delimited`` would give them.

Files in which a line has an odd number of quotes (a record may go on in the next line) or that are not
UTF-8 are left to the reader of whole files.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledger_jobs.sources.files import extension, sniff_delimiter
from ledger_jobs.sources.records import readable
from ledger_jobs.sources.shared import kept

LARGE_BYTES = 128 << 20
#: Lines of a file's beginning among which those that tell its delimiter are looked for.
HEAD_LINES = 1000
#: Slashes behind the scheme of a path, of which there may be one or three.
_SLASHES = (r"^(\w+):/+", "$1:/")
_PARSED = pa.schema([("doc_id", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("bad", pa.bool_())])
_PARSED_DDL = "doc_id string, block bigint, row bigint, cells array<string>, bad boolean"


def listed(spark: SparkSession, path: str, least_bytes: int) -> DataFrame:
    """(doc_id, size_bytes) of the large delimited files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), F.col("length").alias("size_bytes"))
    return files.filter((F.col("size_bytes") > least_bytes) & extension(F.col("doc_id")).isin("csv", "tsv"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(1 << 30)
    for batch in batches:
        lines, marks = batch.column("line").to_pylist(), batch.column("delimiter").to_pylist()
        rows = [next(readable(csv.reader([x], delimiter=m)), None) for x, m in zip(lines, marks, strict=True)]
        bad = [r is None for r in rows]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "block", "row")], pa.array(rows, _PARSED.field("cells").type), pa.array(bad)], schema=_PARSED)


def cells(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """(cells of the files that have a record per line, as ``records.table_cells`` gives them; paths of
    the others).  ``paths`` is a listing of files, of which there are few, as they are large."""
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))  # escaped here, not in listings
    text = spark.read.text(paths).select(F.col("value").alias("line"), F.regexp_replace(path, *_SLASHES).alias("plain"), F.col("_metadata.file_block_start").alias("block"))
    names = spark.createDataFrame([(p,) for p in paths], "doc_id string").withColumn("plain", F.regexp_replace("doc_id", *_SLASHES))
    text = text.join(F.broadcast(names), "plain").drop("plain")
    marked = (F.col("block") == 0) & F.startswith("line", F.lit("\ufeff"))
    text = text.withColumn("line", F.when(marked, F.substring("line", 2, 1 << 30)).otherwise(F.col("line"))).filter("line <> ''")
    lines = kept(text.withColumn("row", F.monotonically_increasing_id()))
    quotes = F.char_length("line") - F.char_length(F.replace("line", F.lit('"')))
    odd = F.max((quotes % 2 == 1) | ~F.is_valid_utf8("line"))
    ranges = kept(lines.groupBy("doc_id", "block").agg(F.min("row").alias("low"), odd.alias("odd")))
    others = sorted(r.doc_id for r in ranges.filter("odd").select("doc_id").distinct().collect())
    head = lines.join(ranges.filter("block = 0").select("doc_id", "block", "low"), ["doc_id", "block"]).filter(F.col("row") < F.col("low") + HEAD_LINES)
    head = head.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x.line).alias("lines"))
    mark = F.when(extension(F.col("doc_id")) == "tsv", "\t").otherwise(sniff_delimiter(F.array_join("lines", "\n")))
    dealt = lines.join(F.broadcast(head.select("doc_id", mark.alias("delimiter"))), "doc_id")  # a row per large file
    parsed = dealt.filter(~F.col("doc_id").isin(others)) if others else dealt
    parsed = kept(parsed.select("doc_id", "block", "row", "line", "delimiter").mapInArrow(_parse, _PARSED_DDL))
    width = F.aggregate("cells", F.lit(0).cast("bigint"), lambda n, c: n + F.octet_length(c) + 1)
    here = Window.partitionBy("doc_id", "block").orderBy("row")  # a range of bytes
    rows = parsed.filter("NOT bad").withColumn("width", width)
    rows = rows.withColumns({"nth": F.row_number().over(here), "upto": F.sum("width").over(here)})
    sizes = parsed.filter("NOT bad").withColumn("width", width).groupBy("doc_id", "block").agg(F.count("*").alias("rows"), F.sum("width").alias("bytes"))
    ranges_before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({c: F.coalesce(F.sum(c).over(ranges_before), F.lit(0)) for c in ("rows", "bytes")})
    placed = rows.join(sizes, ["doc_id", "block"])
    none = F.lit(None).cast("string")
    found = placed.select(
        "doc_id", F.lit(0).alias("block_no"), F.col("doc_id").alias("source"), (F.col("rows") + F.col("nth") - 1).cast("int").alias("line_no"),
        (F.col("bytes") + F.col("upto") - F.col("width")).alias("at"), "cells", none.alias("warning"),
    )
    unread = parsed.groupBy("doc_id").agg(F.count_if("bad").alias("n"), F.count_if(~F.col("bad")).alias("rows"), F.sum(F.when(~F.col("bad"), width)).alias("at")).filter("n > 0")
    warning = F.concat(F.col("n").cast("string"), F.lit(" unreadable CSV row(s) were skipped."))
    told = unread.select(
        "doc_id", F.lit(0).alias("block_no"), F.col("doc_id").alias("source"), F.col("rows").cast("int").alias("line_no"),
        F.coalesce("at", F.lit(0)).alias("at"), F.lit(None).cast("array<string>").alias("cells"), warning.alias("warning"),
    )
    return found.unionByName(told), others
