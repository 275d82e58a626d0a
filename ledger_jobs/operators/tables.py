"""Tables of statements: find the header or infer the columns, then read rows as transactions.

Cells come as ``doc_id, block_no, source, line_no, cells``; a block is one table.  Each cell is
parsed once, as date and as money, and the result is written: header search, inference and
reading all start from it.  Column maps are small (one row per block, from its first 30 or 200
rows) and are joined back by block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_jobs.functions.dates import find_date, find_time, parse_date
from ledger_jobs.functions.money import find_amounts, parse_amount
from ledger_jobs.functions.text import classify_text, clean, direction_from_type, let, trim
from ledger_jobs.operators.trail import fix_directions
from ledger_jobs.sources.shared import kept

BLOCK = ["doc_id", "block_no"]
HEADER_ROWS, INFER_ROWS = 30, 200
#: Columns of transactions as they are read from blocks.
PARSED = ("doc_id", "block_no", "source", "line_no", "date", "time_sec", "description", "amount", "direction", "balance", "raw")
ROLES = ("date", "description", "debit", "credit", "amount", "balance", "type_ind")
# Words of header cells.
HEADER_WORDS = (
    "date", "description", "narration", "narrative", "details", "particular", "transaction", "debit", "withdrawal", "credit",
    "deposit", "amount", "balance", "value", "reference", "type", "dr", "cr", "memo", "payee", "paid out", "paid in",
    "money out", "money in", "counter party", "category", "currency", "notes",
)


def parse_cells(cells: DataFrame) -> DataFrame:
    """``cells`` with ``parsed``, an array of struct(cell, filled, date, money)."""

    def one(c: Column) -> Column:
        return F.struct(c.alias("cell"), (trim(c) != "").alias("filled"), parse_date(c).alias("date"), parse_amount(c).alias("money"))

    return kept(cells.select(*BLOCK, "source", "line_no", F.transform("cells", one).alias("parsed")))


def header_score(parsed: Column) -> Column:
    """Cells that are, or hold with at most twelve bytes more, a header word; 0 for a row with a
    date in it."""
    words = F.array(*map(F.lit, HEADER_WORDS))

    def titled(x: Column) -> Column:
        return let(trim(F.lower(x.cell)), lambda low: F.exists(words, lambda w: F.contains(low, w) & (F.octet_length(low) <= F.length(w) + 12)))

    return F.when(F.exists(parsed, lambda x: x.date.isNotNull()), 0).otherwise(F.size(F.filter(parsed, titled)))


# Titles by role, in the order in which roles are looked for: words anywhere in the
# title, whole titles, ends of titles.
ROLE_WORDS = (
    ("balance", ("balance",), (), ()),
    ("type_ind", ("debit.*credit", "credit.*debit", "dr/cr", "cr/dr", "indicator"), ("type",), (" type",)),
    ("debit", ("withdraw", "debit", "money out", "paid out"), ("dr", "out"), ()),
    ("credit", ("deposit", "credit", "money in", "paid in"), ("cr", "in"), ()),
    ("date", ("date", "posted"), (), ()),
    ("amount", ("amount", "value"), (), ()),
)
# How good a title is for the text that people read, and titles that never are it.
TITLE_WORDS = (
    (9, ("description", "narrati"), (), ()), (8, ("details", "particular"), (), ()), (7, ("memo",), (), ()),
    (6, ("counter party", "counterparty", "payee", "merchant"), ("name",), ()), (4, ("reference",), (), ()),
    (3, ("transaction",), (), ()), (2, ("notes",), (), ()),
)
NO_TITLE = (("^account",), ("id",), (" id",))


def _titled(low: Column, anywhere: tuple[str, ...], whole: tuple[str, ...], ends: tuple[str, ...]) -> Column:
    return low.rlike("|".join([*anywhere, *[f"^{w}$" for w in whole], *[f"{e}$" for e in ends]]))


def description_rank(low: Column) -> Column:
    """How good a title is for the column that people read; 0 is none."""
    ranked = reduce(lambda c, r: c.when(_titled(low, *r[1:]), r[0]), TITLE_WORDS, F.when(_titled(low, *NO_TITLE), 0))
    return ranked.otherwise(0)


def header_role(low: Column) -> Column:
    """Role of a header cell, by the first rule that fits; null for none."""
    found = reduce(lambda c, r: c.when(_titled(low, *r[1:]), r[0]), ROLE_WORDS, F.when(low == "", None))
    return found.when(description_rank(low) > 0, "description")


def header_maps(cells: DataFrame) -> DataFrame:
    """Per block with a header (the first of the best rows among the first 30): where data start
    and the column of each role."""
    scored = cells.filter(F.col("line_no") < HEADER_ROWS).withColumn("score", header_score(F.col("parsed"))).filter("score >= 2")
    best = scored.groupBy(*BLOCK).agg(F.max_by(F.struct("line_no", "parsed"), F.col("score") * 1000 - F.col("line_no")).alias("h"))
    titles = best.select(*BLOCK, (F.col("h.line_no") + 1).alias("start"), F.posexplode("h.parsed.cell").alias("pos", "title"))
    titles = titles.withColumn("low", trim(F.lower("title")))
    titles = titles.withColumns({"role": header_role(F.col("low")), "rank": description_rank(F.col("low"))})
    first = [F.min(F.when(F.col("role") == r, F.col("pos"))).alias(r) for r in ROLES if r != "description"]
    named = F.max_by(F.when(F.col("role") == "description", F.col("pos")), F.when(F.col("role") == "description", F.col("rank") * 10_000 - F.col("pos")))
    return titles.groupBy(*BLOCK, "start").agg(*first, named.alias("description")).select(*BLOCK, "start", *ROLES)


def inferred_maps(cells: DataFrame) -> DataFrame:
    """Per block, columns by what their cells are in the first 200 rows: mostly dates, text or
    numbers; of several numeric columns the last is the balance and the one before the amount."""
    flat = cells.filter(F.col("line_no") < INFER_ROWS).select(*BLOCK, F.posexplode("parsed").alias("pos", "x")).filter("x.filled")
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    by_column = flat.groupBy(*BLOCK, "pos").agg(share("x.date").alias("dates"), share("x.money").alias("numbers"), F.avg(F.char_length("x.cell")).alias("length"))
    cols = by_column.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.struct("pos", "dates", "numbers", "length"))).alias("cols"))
    # of equals the last column counts
    top = lambda kept, by: F.array_max(F.transform(kept, lambda c: F.struct(c[by].alias("by"), c.pos.alias("pos")))).pos
    rows = cols.withColumn("date", top(F.filter("cols", lambda c: c.dates > 0.5), "dates"))
    other = lambda c: F.col("date").isNull() | (c.pos != F.col("date"))
    numeric = F.transform(F.filter("cols", lambda c: other(c) & (c.numbers > 0.5)), lambda c: c.pos)
    rows = rows.withColumns({"description": top(F.filter("cols", lambda c: other(c) & (c.numbers < 0.5)), "length"), "numeric": numeric})
    several = F.size("numeric") > 1
    amount = F.when(several, F.element_at("numeric", -2)).otherwise(F.try_element_at("numeric", F.lit(1)))
    nothing = {r: F.lit(None).cast("int") for r in ("debit", "credit", "type_ind")}
    rows = rows.withColumns({"amount": amount, "balance": F.when(several, F.element_at("numeric", -1)), "start": F.lit(0)} | nothing)
    return rows.select(*BLOCK, "start", *ROLES)


def column_maps(cells: DataFrame) -> DataFrame:
    titled = header_maps(cells)
    return titled.unionByName(inferred_maps(cells.join(titled.select(*BLOCK), BLOCK, "left_anti")))


def transactions(cells: DataFrame) -> DataFrame:
    """Transactions of all tables, with the columns ``PARSED``."""
    cells = parse_cells(cells)
    maps = kept(column_maps(cells))
    rows = cells.join(maps, BLOCK).filter((F.col("line_no") >= F.col("start")) & F.exists("parsed", lambda x: x.filled))

    def at(role: str) -> Column:
        found = F.try_element_at("parsed", F.col(role) + 1)
        return F.when(F.col(role).isNotNull(), let(found, lambda x: F.when(x.filled, x)))

    rows = rows.select(*BLOCK, "source", "line_no", "parsed", F.array_join("parsed.cell", " ").alias("joined"), *[at(r).alias(f"{r}_cell") for r in ROLES],
                       (F.col("debit").isNotNull() | F.col("credit").isNotNull()).alias("sided"), F.col("amount").isNotNull().alias("single"))
    rows = rows.withColumn("negative", (F.col("amount_cell.money.value") < 0) | F.col("amount_cell.money.negative_hint"))
    flags = rows.groupBy(*BLOCK).agg(F.coalesce(F.bool_or("negative") & F.bool_and(~F.col("sided")), F.lit(False)).alias("signed"))
    rows = rows.join(flags, BLOCK)
    side = lambda r: F.nullif(F.abs(F.col(f"{r}_cell.money.value")), F.lit(0.0))
    first = F.try_element_at(find_amounts(F.col("joined")), F.lit(1)).money
    rows = rows.withColumns({"out": side("debit"), "in": side("credit"), "found": F.when(~F.col("sided") & F.col("amount_cell.money").isNull(), first)})
    worded = classify_text(F.col("joined"), F.lit(False))
    by_sign = F.when(F.col("negative"), "debit").when(F.col("signed"), "credit").otherwise(F.coalesce(direction_from_type(F.col("type_ind_cell.cell")), worded))
    amount = F.when(F.col("sided"), F.coalesce("out", "in")).otherwise(F.abs(F.coalesce("amount_cell.money.value", "found.value")))
    direction = (
        F.when(F.col("sided"), F.when(F.col("out").isNotNull(), "debit").otherwise("credit"))
        .when(F.col("amount_cell.money").isNotNull(), by_sign).otherwise(classify_text(F.col("joined"), F.coalesce("found.negative_hint", F.lit(False))))
    )
    plain = F.filter("parsed", lambda x: x.money.isNull() & x.date.isNull())
    longest = F.array_max(F.transform(plain, lambda x, i: F.struct(F.octet_length(x.cell).alias("n"), i.alias("i"), x.cell.alias("c")))).c
    title = F.nullif(F.regexp_replace(trim(F.col("description_cell.cell")), "^'+", ""), F.lit(""))
    out = rows.select(
        *BLOCK, "source", "line_no",
        F.coalesce("date_cell.date", find_date(F.col("joined"))).alias("date"),
        F.coalesce(find_time(F.col("date_cell.cell")), find_time(F.col("joined"))).alias("time_sec"),
        clean(F.coalesce(title, longest, F.lit(""))).alias("description"), amount.alias("amount"), direction.alias("direction"),
        F.col("balance_cell.money.value").alias("balance"), clean(F.col("joined")).alias("raw"),
        (F.col("single") & ~F.col("sided") & ~F.col("signed")).alias("unsigned"),
    ).filter("amount > 0")
    out = kept(out.withColumn("txn_seq", F.col("line_no").cast("long")))
    fixed = fix_directions(out.filter("unsigned")).unionByName(out.filter("NOT unsigned"))
    return fixed.select(*PARSED)


def sequenced(parsed: DataFrame) -> DataFrame:
    """The canonical columns: parsed transactions numbered by block and line within their statement,
    with ``ts`` where there are a date and a clock time."""
    clock = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("time_sec").cast("decimal(18,6)"))
    ts = F.when(F.col("date").isNotNull() & F.col("time_sec").isNotNull(), F.col("date").cast("timestamp_ntz") + clock)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no", "line_no")).cast("long")
    return parsed.withColumns({"txn_seq": seq, "ts": ts}).select(
        "doc_id", "txn_seq", "block_no", "source", "line_no", "date", "time_sec", "ts", "description", "amount", "direction", "balance", "raw"
    )


def primary_sheets(rows: DataFrame) -> DataFrame:
    """Of each workbook's sheets that are not blank, the rows of the one with the most rows (the
    first of equals), with the names of the others in sheet order (``skipped``); rows are
    ``workbook, sheet_no, sheet, line_no, cells``."""
    filled = rows.withColumn("filled", F.exists("cells", lambda c: trim(c) != ""))
    sizes = filled.groupBy("workbook", "sheet_no", "sheet").agg(F.count("*").alias("n"), F.bool_or("filled").alias("filled")).filter("filled")
    best = F.max_by("sheet_no", F.struct("n", -F.col("sheet_no"))).alias("sheet_no")
    names = F.transform(F.sort_array(F.collect_list(F.struct("sheet_no", "sheet"))), lambda x: x.sheet)
    chosen = sizes.groupBy("workbook").agg(best, names.alias("sheets"))
    return rows.join(chosen, ["workbook", "sheet_no"]).withColumn("skipped", F.array_remove("sheets", F.col("sheet"))).drop("sheets")


def skipped_sheets(primary: DataFrame) -> DataFrame:
    """(doc_id, warning) of workbooks of which sheets were left out."""
    named = primary.filter(F.size("skipped") > 0).groupBy("workbook").agg(F.first("skipped").alias("skipped"))
    text = F.concat(F.lit("Analysed the largest sheet; skipped: "), F.array_join("skipped", ", "))
    return named.select(F.col("workbook").alias("doc_id"), text.alias("warning"))


def sheet_cells(primary: DataFrame) -> DataFrame:
    """The rows of primary sheets as cells of one block per workbook."""
    return primary.select(F.col("workbook").alias("doc_id"), F.lit(0).alias("block_no"), F.col("sheet").alias("source"), "line_no", "cells")
