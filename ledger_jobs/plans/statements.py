"""W1 and W2: directories of statement files to transactions, and searches to result documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledger_jobs.functions.formats import human_size
from ledger_jobs.functions.money import fmt_money
from ledger_jobs.operators import currency, lines, match, stats, tables
from ledger_jobs.sources import files, large_files, records
from ledger_jobs.sources.shared import kept

SIDES = ("debit", "credit")
NO_TRANSACTIONS = "No transactions could be parsed from this file."


class Statements(NamedTuple):
    """Tables of one corpus: ``files`` (one row per statement: doc_id, kind, size_bytes, parts,
    warnings), transactions, and one row of currency per statement."""

    files: DataFrame
    txns: DataFrame
    currencies: DataFrame


def read(spark: SparkSession, path: str, without: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, texts) of all files and archive members below a path, each written once."""
    loaded = files.load(spark, path)
    members = kept(files.expand(loaded.filter(~F.col("doc_id").isin(without)) if without else loaded))
    return members.drop("content"), kept(files.kinds(files.decode(members)))


def read_and_parse(spark: SparkSession, path: str, as_of_year: int, large_bytes: int = large_files.LARGE_BYTES) -> Statements:
    """W1 over a folder: delimited files over ``large_bytes`` are read by many tasks each, if they have
    a record per line, and all other files whole."""
    large = large_files.listed(spark, path, large_bytes)
    paths = [r.doc_id for r in large.select("doc_id").collect()]
    if not paths:
        return parse(*read(spark, path), as_of_year)
    cells, others = large_files.cells(spark, paths)
    members, texts = read(spark, path, [p for p in paths if p not in others])
    large = large.filter(~F.col("doc_id").isin(others)) if others else large
    none = F.lit(None).cast("string")
    place = ["doc_id", F.lit(0).alias("block_no"), F.col("doc_id").alias("source"), none.alias("part"), "size_bytes", F.lit(0).cast("bigint").alias("offset")]
    members = members.unionByName(large.select(*place, none.alias("warning")))
    # such a file's text is in the cells; an empty one stands for its kind
    empty = large.select("doc_id", F.lit(0).alias("block_no"), F.col("doc_id").alias("source"), "size_bytes", F.lit(0).cast("bigint").alias("offset"), F.lit("").alias("text"))
    return parse(members, texts.unionByName(files.kinds(empty)), as_of_year, cells)


def transactions(cells: DataFrame, blocks: DataFrame | None, as_of_year: int) -> DataFrame:
    """Transactions of tables and of blocks of text, if any, in the order of their statement."""
    found = tables.transactions(cells)
    return tables.sequenced(found if blocks is None else found.unionByName(lines.transactions(blocks, as_of_year)))


def parse(members: DataFrame, texts: DataFrame, as_of_year: int, more_cells: DataFrame | None = None) -> Statements:
    """Everything that is known of a corpus, whose ``texts`` are a written table, before anybody
    searches it.  ``more_cells``: cells of files that are not among the texts."""
    kinds = records.kinds_in(texts)
    cells, blocks = records.table_cells(texts, kinds)
    cells, blocks = kept(cells if more_cells is None else cells.unionByName(more_cells)), blocks if "text" in kinds else None
    rows = cells.filter("cells IS NOT NULL")
    txns = kept(transactions(rows, blocks, as_of_year))
    looked_at = rows.select("doc_id", "at", F.array_join("cells", " ").alias("text"))
    if blocks is not None:
        looked_at = looked_at.unionByName(blocks.select("doc_id", F.col("offset").alias("at"), "text"))
    return Statements(_files(members, texts, cells, blocks, txns), txns, currency.detect(looked_at))


def parse_sheets(sheets: DataFrame, as_of_year: int) -> Statements:
    """Workbooks whose sheets are already rows of cells (``workbook, sheet_no, sheet, line_no, cells``):
    each is a statement, read from its largest sheet, with a warning that names the others."""
    primary = kept(tables.primary_sheets(sheets))
    width = F.aggregate("cells", F.lit(0).cast("bigint"), lambda n, c: n + F.coalesce(F.octet_length(c), F.lit(0)) + 1)
    before = F.sum(width).over(Window.partitionBy("doc_id").orderBy("line_no")) - width
    none = F.lit(None).cast("string")
    cells = tables.sheet_cells(primary).select("doc_id", "block_no", "source", "line_no", before.alias("at"), "cells", none.alias("warning"))
    told = tables.skipped_sheets(primary).select(
        "doc_id", F.lit(0).alias("block_no"), F.col("doc_id").alias("source"), F.lit(0).alias("line_no"), F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("array<string>").alias("cells"), "warning"
    )
    books = kept(sheets.groupBy(F.col("workbook").cast("string").alias("doc_id")).agg(F.sum(width).alias("size_bytes")))
    place = ["doc_id", F.lit(0).alias("block_no"), F.col("doc_id").alias("source")]
    members = books.select(*place, none.alias("part"), "size_bytes", F.lit(0).cast("bigint").alias("offset"), none.alias("warning"))
    texts = books.select(*place, "size_bytes", F.lit(0).cast("bigint").alias("offset"), F.lit("").alias("text"), F.lit("spreadsheet").alias("kind"))
    return parse(members, texts, as_of_year, cells.unionByName(told))


def _files(members: DataFrame, texts: DataFrame, cells: DataFrame, blocks: DataFrame | None, txns: DataFrame) -> DataFrame:
    """One row per statement, with the names of its parts and its warnings in their order."""
    named = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "part"))), lambda x: x.part), lambda p: p.isNotNull())
    docs = members.groupBy("doc_id").agg(F.max("size_bytes").alias("size_bytes"), F.array_distinct(named).alias("parts"))
    kinds = texts.groupBy("doc_id").agg(F.min_by("kind", "block_no").alias("kind"))
    place = lambda rank, warning: (F.lit(rank).alias("rank"), F.col("block_no"), warning.alias("warning"))
    binary = F.concat(F.lit("Unsupported binary file type for '"), "source", F.lit("'."))
    found = members.filter("warning IS NOT NULL").select("doc_id", *place(0, F.col("warning")))
    found = found.unionByName(texts.filter("kind = 'binary'").select("doc_id", *place(0, binary)))
    found = found.unionByName(cells.filter("warning IS NOT NULL").select("doc_id", *place(0, F.col("warning"))))
    empty = docs.join(txns.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(1).alias("rank"), F.lit(0).alias("block_no"), F.lit(NO_TRANSACTIONS).alias("warning"))
    every = found.unionByName(empty)
    if blocks is not None:
        every = every.unionByName(lines.accounts(blocks).select("doc_id", F.lit(2).alias("rank"), F.lit(0).alias("block_no"), "warning"))
    warnings = every.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block_no", "warning"))), lambda w: w.warning).alias("warnings"))
    kind = F.when(F.size("parts") > 0, "archive").otherwise(F.coalesce("kind", F.lit("unknown")))
    return docs.join(kinds, "doc_id", "left").join(warnings, "doc_id", "left").select(
        "doc_id", kind.alias("kind"), "size_bytes", "parts", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings")
    )


def results(found: Statements) -> DataFrame:
    """One row per statement: currency, both sides, net as text, warnings; zeros without transactions."""
    named = found.files.withColumnRenamed("warnings", "file_warnings")  # these tell of empty statements too
    summary = stats.with_empty(stats.summarise(found.txns, "doc_id"), named, "doc_id").drop("warnings").withColumnRenamed("file_warnings", "warnings")
    return stats.formatted(summary.join(found.currencies, "doc_id", "left"), F.coalesce("symbol", F.lit("")))


class SearchResults(NamedTuple):
    """Results of statements x searches without their product: one row per search (as interpreted),
    one per statement (file, currency, scanned, first and last date), and one for each pair of them
    with matches or with an anchor found: statistics, the first matches, the anchor."""

    asked: DataFrame
    docs: DataFrame
    found: DataFrame


def sparse_results(found: Statements, searches: DataFrame) -> SearchResults:
    """Every statement and every (interpreted) search: what is written grows with the matches."""
    q = kept(searches)
    docs = found.files.join(found.currencies, "doc_id", "left").join(match.spans(found.txns), "doc_id", "left")
    matched = match.matches(found.txns, q)
    item = F.struct("rank", "date", "time", "description", "amount", "direction", "source")
    listed = match.matched_list(matched).groupBy(*match.KEYS).agg(F.sort_array(F.collect_list(item)).alias("list"))
    rows = stats.summarise(matched, *match.KEYS).join(listed, match.KEYS, "left").join(match.resolve_anchors(found.txns, q), match.KEYS, "full")
    return SearchResults(q, docs.withColumnRenamed("warnings", "file_warnings"), rows)


def spelled_out(results: SearchResults) -> DataFrame:
    """The nested result document of every statement and every search, those without matches too:
    file, currency, what the search was understood as, summary, both sides, the first matches, warnings."""
    asked = results.asked.select("query_id", "text", "keyword", "direction", "date_from", "date_to", "amount_min", "amount_max", "human", "smart", "anchor")
    every = stats.with_empty(results.found, match.every_pair(results.docs, asked), *match.KEYS).drop("warnings")
    every = every.withColumn("symbol", F.coalesce("symbol", F.lit(""))).withColumn("notices", F.when(F.col("scanned").isNotNull(), match.notices_of_pair()))
    return nested(stats.formatted(every, F.col("symbol")))


def search_results(found: Statements, searches: DataFrame) -> DataFrame:
    return spelled_out(sparse_results(found, searches))


def write_sparse(results: SearchResults, path: str) -> None:
    for name, table in results._asdict().items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_sparse(spark: SparkSession, path: str) -> SearchResults:
    return SearchResults(*[spark.read.parquet(f"{path}/{name}") for name in SearchResults._fields])


def nested(rows: DataFrame) -> DataFrame:
    """Flat results as documents."""
    symbol = F.coalesce("symbol", F.lit(""))

    def side(s: str) -> Column:
        keys = ("total", "count", "average", "min", "max", "first", "last", "duration")
        return F.struct(*[F.col(f"{s}_{k}").alias(k) for k in keys], fmt_money(symbol, F.col(f"{s}_total")).alias("total_text")).alias(s)

    items = F.coalesce(F.transform("list", lambda x: x.dropFields("rank")), F.array().cast("array<struct<date: date, time: string, description: string, amount: double, direction: string, source: string>>"))
    return rows.select(
        "doc_id", "query_id", F.col("text").alias("query"),
        F.struct("keyword", "direction", "date_from", "date_to", "human", "smart").alias("interpreted"),
        F.struct(F.element_at(F.split("doc_id", "/"), -1).alias("name"), "kind", "size_bytes", human_size(F.col("size_bytes")).alias("size"), "parts").alias("file"),
        F.struct("symbol", "code", "name", "confidence", "detected_by").alias("currency"),
        F.struct(F.coalesce("scanned", F.lit(0)).alias("scanned"), "matched", "net", "net_text", "first_date", "last_date", "duration").alias("summary"),
        *[side(s) for s in SIDES],
        items.alias("matched"), (F.col("matched") > match.MOST_MATCHES).alias("truncated"),
        F.concat("file_warnings", F.coalesce("notices", F.array().cast("array<string>"))).alias("warnings"),
    )


def write(documents: DataFrame, path: str) -> None:
    """Result documents as JSON lines."""
    documents.write.mode("overwrite").json(path)
