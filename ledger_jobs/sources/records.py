"""Records in statement files as rows of cells: delimited, QIF, OFX, key and value.

Texts come as ``doc_id, block_no, source, offset, text, kind``, one row per block.  Cells are
``doc_id, block_no, source, line_no, at, cells, warning``: ``at`` is how many bytes of the statement
stand before a row; rows with a warning have no cells.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_jobs.functions.text import trim
from ledger_jobs.sources.files import sniff_delimiter

HEADER = ("Date", "Description", "Amount", "Balance")
BLOCK = ["doc_id", "block_no", "source"]
CELLS = pa.schema(
    [("doc_id", pa.string()), ("block_no", pa.int32()), ("source", pa.string()), ("line_no", pa.int32()), ("at", pa.int64()),
     ("cells", pa.list_(pa.string())), ("warning", pa.string())]
)
CELLS_DDL = "doc_id string, block_no int, source string, line_no int, at bigint, cells array<string>, warning string"
#: Rows of cells that go out at once.
ROWS = 5000
LEAST_AMOUNTS = 3
FIELD = r"(?i)^\s*(date|description|amount|balance):"


def readable(rows) -> Iterator[list[str] | None]:
    """The rows of a reader; None for each that it cannot read."""
    while True:
        try:
            row = next(rows)
        except StopIteration:
            return
        except csv.Error:
            row = None
        if row != []:
            yield row


def _delimited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(1 << 30)
    for batch in batches:
        for doc, block, source, offset, text, mark in zip(*(batch.column(c).to_pylist() for c in (*BLOCK, "offset", "text", "delimiter")), strict=True):
            every = list(readable(csv.reader(io.StringIO(text, newline=""), delimiter=mark)))
            rows = [r for r in every if r is not None]
            warnings = [None] * len(rows)
            if bad := len(every) - len(rows):
                rows.append(None)
                warnings.append(f"{bad} unreadable CSV row(s) were skipped.")
            at = [offset]
            for r in rows:
                at.append(at[-1] + sum(len(c.encode()) + 1 for c in r or ()))
            for start in range(0, len(rows), ROWS):
                part, n = slice(start, start + ROWS), len(rows[start : start + ROWS])
                columns = ([doc] * n, [block] * n, [source] * n, range(start, start + n), at[:-1][part], rows[part], warnings[part])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CELLS, strict=True)], schema=CELLS)


def delimited(texts: DataFrame) -> DataFrame:
    """Ragged records of delimited files (quotes may span lines, each file has its delimiter).  Rows
    that cannot be read are counted in a warning."""
    mark = F.when(F.col("kind") == "tsv", "\t").otherwise(sniff_delimiter(F.col("text")))
    return texts.select(*BLOCK, "offset", "text", mark.alias("delimiter")).mapInArrow(_delimited, CELLS_DDL)


def plain_text(text: Column) -> Column:
    """Text with blanks for no-break spaces and one kind of line end, none at the end."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\xa0"), F.lit(" ")), "\r\n", "\n"), "\n$", "")


def text_lines(texts: DataFrame) -> DataFrame:
    """Lines of texts, numbered from 0."""
    return texts.select(*BLOCK, "offset", F.posexplode(F.split(plain_text(F.col("text")), "\n")).alias("line_no", "line"))


def _with_header(records: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """Records (doc_id, block_no, source, offset, n, cells) with a header row first."""
    if header is None:
        header = records.select(*BLOCK, "offset").distinct().withColumn("cells", F.array(*map(F.lit, HEADER)))
    rows = records.select(*BLOCK, "offset", "n", "cells").unionByName(header.select(*BLOCK, "offset", F.lit(-1).cast("long").alias("n"), "cells"))
    walk = Window.partitionBy(*BLOCK).orderBy("n")
    size = F.octet_length(F.array_join("cells", " ")) + 1
    at = F.col("offset") + F.coalesce(F.sum(size).over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(*BLOCK, (F.row_number().over(walk) - 1).alias("line_no"), at.cast("long").alias("at"), "cells", F.lit(None).cast("string").alias("warning"))


def _last(value: Column, when: Column) -> Column:
    """The last value of a record's lines of one kind, empty without any."""
    return F.coalesce(F.max_by(F.when(when, value), F.when(when, F.col("line_no"))), F.lit(""))


def qif(texts: DataFrame) -> DataFrame:
    """QIF records: up to each ``^``; the last of equal tags counts, records without amount go."""
    lines = text_lines(texts).withColumn("line", trim(F.col("line"))).filter("line <> ''")
    lines = lines.withColumns({"tag": F.substring("line", 1, 1), "value": trim(F.expr("substring(line, 2)"))})
    before = Window.partitionBy(*BLOCK).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("n", F.coalesce(F.count_if(F.col("tag") == "^").over(before), F.lit(0)))
    tags = {"date": ("D",), "amount": ("T", "U"), "payee": ("P",), "memo": ("M",)}
    found = lines.groupBy(*BLOCK, "offset", "n").agg(
        *[_last(F.col("value"), F.col("tag").isin(*t)).alias(name) for name, t in tags.items()], F.bool_or(F.col("tag") == "^").alias("ended")
    )
    day = F.replace(F.replace("date", F.lit("'"), F.lit("/")), F.lit(" "))
    cells = F.array(day, trim(F.concat_ws(" ", "payee", "memo")), F.col("amount"), F.lit(""))
    return _with_header(found.filter("ended AND amount <> ''").withColumn("cells", cells))


def ofx(texts: DataFrame) -> DataFrame:
    """OFX and QFX: a record per STMTTRN, tags up to the next one or the end of the line."""
    parts = texts.select(*BLOCK, "offset", F.posexplode(F.split("text", "(?i)<STMTTRN>")).alias("n", "part")).withColumn("n", F.col("n").cast("long"))
    tag = lambda name: F.replace(trim(F.regexp_extract("part", rf"(?i)<{name}>([^<\r\n]*)", 1)), F.lit("&amp;"), F.lit("&"))
    parts = parts.filter("n > 0").withColumns({"day": F.substring(tag("DTPOSTED"), 1, 8), "amount": tag("TRNAMT")})
    text = F.array_join(F.filter(F.array(tag("NAME"), tag("MEMO")), lambda x: x != ""), " ")
    records = parts.filter("amount <> ''").withColumn("cells", F.array("day", text, "amount", F.lit("")))
    code = F.regexp_extract("text", "(?i)<CURDEF>([A-Za-z]*)", 1)
    amount = F.when(code != "", F.concat(F.lit("Amount ("), code, F.lit(")"))).otherwise("Amount")
    return _with_header(records, texts.select(*BLOCK, "offset", F.array(F.lit("Date"), F.lit("Description"), amount, F.lit("Balance")).alias("cells")))


def has_key_values(text: Column) -> Column:
    """Whether a text has enough amount fields to be read as blocks of fields."""
    return F.regexp_count(text, F.lit(r"(?im)^\s*amount:")) >= LEAST_AMOUNTS


def key_values(texts: DataFrame) -> DataFrame:
    """Blocks of ``Date: / Description: / Amount: / Balance:`` lines; a date starts a record,
    records without amount go."""
    rows = text_lines(texts)
    rows = rows.withColumns({"field": F.lower(F.regexp_extract("line", FIELD, 1)), "value": trim(F.regexp_replace("line", FIELD, ""))}).filter("field <> ''")
    upto = Window.partitionBy(*BLOCK).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.count_if(F.col("field") == "date").over(upto))
    fields = [f.lower() for f in HEADER]
    found = rows.groupBy(*BLOCK, "offset", "n").agg(*[_last(F.col("value"), F.col("field") == f).alias(f) for f in fields])
    return _with_header(found.filter("amount <> ''").withColumn("cells", F.array(*fields)))


def kinds_in(texts: DataFrame) -> set[str]:
    """The kinds that occur in routed texts, of which there are at most six."""
    return {row.kind for row in texts.select("kind").distinct().collect()}


def table_cells(texts: DataFrame, kinds: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells of everything that is a table, and the blocks of text of the rest, of routed texts.  If
    it is known which ``kinds`` occur, readers of others are not planned."""
    of = lambda *names: texts.filter(F.col("kind").isin(*names))
    text = of("text").withColumn("text", plain_text(F.col("text")))
    pairs = has_key_values(F.col("text"))
    readers = {
        ("csv", "tsv"): lambda: delimited(of("csv", "tsv")), ("qif",): lambda: qif(of("qif")), ("ofx",): lambda: ofx(of("ofx")),
        ("text",): lambda: key_values(text.filter(pairs)),
    }
    found = [read() for names, read in readers.items() if kinds is None or kinds & set(names)]
    cells = reduce(DataFrame.unionByName, found or [delimited(of("csv", "tsv"))])
    return cells, text.filter(~pairs).select(*BLOCK, "offset", "text")
