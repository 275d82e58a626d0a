"""Saved searches applied to transactions: filters, anchors, windows around anchors, results.

Searches and transactions meet in a join whose condition is the conjunction of all filters.  The
search side is broadcast only if it has at most ``BROADCAST_ROWS`` rows; beyond that both sides are
filed under equal keys (``search_index``).  Everything after the join is keyed by (query_id, doc_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_jobs.functions.money import fmt_money, round2
from ledger_jobs.functions.text import anchor_words, tokens_any_match, truncate
from ledger_jobs.operators import search_index
from ledger_jobs.operators.stats import summarise

BROADCAST_ROWS = 10_000
MOST_MATCHES = 2_000
KEYS = ["query_id", "doc_id"]


def passes(keyword: bool = True) -> Column:
    """Filters of a search ``q`` on a transaction ``t``: cheap ones first.

    Rows without a date fail a date range; rows without a clock time pass hours of the day."""
    q, t = (lambda c: F.col(f"q.{c}")), (lambda c: F.col(f"t.{c}"))
    ok = (q("direction").isNull() | (t("direction") == q("direction")))
    ok = ok & (q("date_from").isNull() | q("date_to").isNull() | F.coalesce(t("date").between(q("date_from"), q("date_to")), F.lit(False)))
    ok = ok & (q("amount_min").isNull() | (t("amount") >= q("amount_min"))) & (q("amount_max").isNull() | (t("amount") <= q("amount_max")))
    hour = F.floor(t("time_sec") / 3600)
    ok = ok & ((F.size(q("hours")) == 0) | t("time_sec").isNull() | F.exists(q("hours"), lambda h: hour.between(h.lo, h.hi)))
    if keyword:
        word = F.lower(q("keyword"))
        ok = ok & ((word == "") | F.contains(F.lower(t("description")), word) | F.contains(F.lower(t("raw")), word))
    return ok


def meet(txns: DataFrame, searches: DataFrame, condition: Column, ask: search_index.Ask, filed: Column | None = None) -> DataFrame:
    """Pairs of ``t`` and ``q`` that fulfil the condition, of which ``ask`` says what can be filed;
    ``filed``: what is left of the condition for pairs whose word is known to stand in the text."""
    if few(searches):
        return txns.alias("t").join(F.broadcast(searches.alias("q")), condition)
    return search_index.meet(txns, searches, condition if filed is None else filed, ask)


def asked() -> search_index.Ask:
    """What a search asks of the transactions that it matches."""
    word = F.lower("keyword")
    words = F.when(word == "", F.array().cast("array<string>")).otherwise(F.array(word))
    return search_index.Ask(words, *[F.col(c) for c in ("date_from", "date_to", "amount_min", "amount_max", "direction", "hours")])


def asked_of_anchors() -> search_index.Ask:
    """What a search asks of its anchor; the amount a little wider, against rounding."""
    word, amount, day = F.lower("anchor.keyword"), F.col("anchor.amount"), F.col("anchor.on_date")
    words = F.when(word == "", F.array().cast("array<string>")).otherwise(anchor_words(F.col("anchor.keyword")))
    apart = F.greatest(amount * 0.02, F.lit(50.0)) + 0.01
    none = F.array().cast("array<struct<lo: int, hi: int>>")
    return search_index.Ask(words, day, day, amount - apart, amount + apart, F.lit(None).cast("string"), none)


def resolve_anchors(txns: DataFrame, searches: DataFrame) -> DataFrame:
    """(query_id, doc_id, anchor_txn): per statement the first dated transaction that fits a
    search's anchor: its day, any of its words, and its amount within 2 % or 50."""
    q, t = (lambda c: F.col(f"q.anchor.{c}")), (lambda c: F.col(f"t.{c}"))
    fits = t("date").isNotNull() & (q("on_date").isNull() | (t("date") == q("on_date")))
    fits = fits & (q("amount").isNull() | (F.abs(t("amount") - q("amount")) <= F.greatest(q("amount") * 0.02, F.lit(50.0))))
    fits = fits & tokens_any_match(q("keyword"), t("description"), t("raw"))
    found = meet(txns, searches.filter("anchor IS NOT NULL"), fits, asked_of_anchors())
    row = F.struct("t.txn_seq", "t.date", "t.time_sec", "t.ts", "t.source", "t.line_no", "t.description", "t.amount")
    return found.groupBy("q.query_id", "t.doc_id").agg(F.min_by(row, F.col("t.txn_seq")).alias("anchor_txn"))


def in_window() -> Column:
    """Whether a matched row lies in its anchor's window: by clock times to the microsecond if both have
    one, else by the order of lines of one source, on the same or the adjacent day.  Never the anchor itself."""
    a, after, around = F.col("anchor_txn"), F.col("anchor.after"), F.col("anchor.around")
    apart, none = F.col("ts") - a.ts, F.make_dt_interval()
    wide = F.make_dt_interval(hours=F.col("anchor.window_hours").cast("int"))
    clock = F.when(around, (apart != none) & (F.abs(apart) <= wide)).when(after, (apart > none) & (apart <= wide)).otherwise((apart < none) & (-apart <= wide))
    days, here = F.datediff("date", a.date), F.col("source") == a.source
    later, sooner = F.col("line_no") > a.line_no, F.col("line_no") < a.line_no
    order = here & F.when(around, F.abs(days) <= 1).when(after, (days == 1) | ((days == 0) & later)).otherwise((days == -1) | ((days == 0) & sooner))
    timed = F.col("time_sec").isNotNull() & a.time_sec.isNotNull()
    inside = F.coalesce(F.when(F.col("date").isNull(), False).when(timed, clock).otherwise(order), F.lit(False))
    return a.isNull() | (inside & (F.col("txn_seq") != a.txn_seq))


def matches(txns: DataFrame, searches: DataFrame) -> DataFrame:
    """Matched transactions with query_id; searches whose anchor is not found run without it."""
    pairs = meet(txns, searches, passes(), asked(), passes(keyword=False)).select("q.query_id", "q.anchor", *[f"t.{c}" for c in txns.columns])
    plain = pairs.filter("anchor IS NULL").drop("anchor")
    anchored = pairs.filter("anchor IS NOT NULL").join(resolve_anchors(txns, searches), KEYS, "left").filter(in_window())
    return plain.unionByName(anchored.drop("anchor", "anchor_txn"))


def results(matched: DataFrame, txns: DataFrame, searches: DataFrame) -> DataFrame:
    """One row per (query_id, doc_id) with matches: statistics, scanned transactions, and whether
    the list is cut."""
    scanned = txns.groupBy("doc_id").agg(F.count("*").alias("scanned"))
    return summarise(matched, *KEYS).join(scanned, "doc_id").withColumn("truncated", F.col("matched") > MOST_MATCHES)


def matched_list(matched: DataFrame, most: int = MOST_MATCHES) -> DataFrame:
    """The first ``most`` matches per search and statement, in statement order."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("txn_seq"))
    return matched.withColumn("rank", rank).filter(F.col("rank") <= most).select(
        *KEYS, "rank", "date", F.format_string("%02d:%02d", F.floor(F.col("time_sec") / 3600).cast("int"), F.floor(F.col("time_sec") % 3600 / 60).cast("int")).alias("time"),
        truncate(F.col("description"), 200).alias("description"), round2(F.col("amount")).alias("amount"), "direction", "source",
    )


def few(searches: DataFrame) -> bool:
    return searches.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def every_pair(docs: DataFrame, searches: DataFrame) -> DataFrame:
    """Each statement with each search: where every one of them gets a result."""
    return docs.join(F.broadcast(searches) if few(searches) else searches, how="cross")


def says_nothing() -> Column:
    """Whether a search has no condition that anybody would write in words."""
    empty = (F.col("keyword") == "") & F.col("anchor").isNull()
    for c in ("date_from", "direction", "amount_min", "amount_max"):
        empty = empty & F.col(c).isNull()
    return empty


BLANK_NOTICE = "No search term provided, analysing ALL transactions."


def anchor_notice() -> Column:
    """Where the anchor of a search was found, or that it was not (``anchor_txn`` is null)."""
    a = F.col("anchor_txn")
    side = F.when(F.col("anchor.around"), "either side of").when(F.col("anchor.after"), "after").otherwise("before")
    clock = F.format_string(" %02d:%02d", F.floor(a.time_sec / 3600).cast("int"), F.floor(a.time_sec % 3600 / 60).cast("int"))
    found = F.concat(
        F.lit("Anchored "), side, F.lit(" “"), truncate(a.description, 60), F.lit("” on "), a.date.cast("string"),
        F.when(a.time_sec.isNotNull(), clock).otherwise(""), F.lit(" ("), fmt_money(F.col("symbol"), a.amount), F.lit("). Showing transactions within "),
        F.col("anchor.window_hours").cast("string"), F.lit(" hours."),
    )
    name = F.when(F.col("anchor.keyword") == "", F.lit("any")).otherwise(F.concat(F.lit("“"), F.col("anchor.keyword"), F.lit("”")))
    figure = F.coalesce(F.concat(F.lit(", "), fmt_money(F.col("symbol"), F.col("anchor.amount"))), F.lit(""))
    lost = F.concat(F.lit("Couldn't find the anchor transaction ("), name, figure, F.lit("). Showing results without it."))
    return F.when(a.isNull(), lost).otherwise(found)


def misses_range() -> Column:
    """Whether the dates of a statement (``lo`` to ``hi``) lie outside those of a search."""
    return (F.col("date_from") > F.col("hi")) | (F.col("date_to") < F.col("lo"))


def range_notice() -> Column:
    return F.format_string(
        "This statement covers %s to %s, so nothing falls in the dates you asked for (%s to %s). Try naming the months, for example \"%s\".",
        *[F.col(c).cast("string") for c in ("lo", "hi", "date_from", "date_to")], F.date_format("hi", "MMMM yyyy"),
    )


def notices_of_pair() -> Column:
    """All notices of a search and a statement, given side by side with ``anchor_txn``, ``lo`` and ``hi``."""
    ranged = F.col("date_from").isNotNull() & F.col("date_to").isNotNull() & misses_range()
    return F.array_compact(F.array(F.when(says_nothing(), F.lit(BLANK_NOTICE)), F.when(F.col("anchor").isNotNull(), anchor_notice()), F.when(ranged, range_notice())))


def spans(txns: DataFrame) -> DataFrame:
    """(doc_id, scanned, lo, hi): transactions of each statement, and its first and last date."""
    return txns.groupBy("doc_id").agg(F.count("*").alias("scanned"), F.min("date").alias("lo"), F.max("date").alias("hi"))


def notices(txns: DataFrame, searches: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, notices): blank searches, anchors found and not found, and ranges that
    the statement does not cover.  One row for each pair that has a notice.  ``symbols``: doc_id and
    currency symbol.

    Each kind is found on its own: blank searches and anchored ones meet every statement, as they
    have a notice there; a range meets those statements whose dates it misses, in which nothing can
    match it.
    """
    docs = spans(txns).drop("scanned")
    docs = docs.withColumn("symbol", F.lit("")) if symbols is None else docs.join(symbols, "doc_id", "left").withColumn("symbol", F.coalesce("symbol", F.lit("")))
    told = lambda pairs, rank, text: pairs.select(*KEYS, F.lit(rank).alias("rank"), text.alias("notice"))
    blank = told(every_pair(docs, searches.filter(says_nothing()).select("query_id")), 0, F.lit(BLANK_NOTICE))
    anchored = every_pair(docs, searches.filter("anchor IS NOT NULL").select("query_id", "anchor")).join(resolve_anchors(txns, searches), KEYS, "left")
    anchors = told(anchored, 1, anchor_notice())
    ranged = searches.filter("date_from IS NOT NULL AND date_to IS NOT NULL").select("query_id", "date_from", "date_to")
    missed = docs.join(F.broadcast(ranged) if few(ranged) else ranged, misses_range())
    every = blank.unionByName(anchors).unionByName(told(missed, 2, range_notice()))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "notice"))), lambda x: x.notice)
    return every.groupBy(*KEYS).agg(ordered.alias("notices"))
