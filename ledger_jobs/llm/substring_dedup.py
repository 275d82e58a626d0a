"""Substring dedup: a count-min prefilter, then exact groups of the windows it lets through.

A window is ``WINDOW`` consecutive words of one text.  Every word that lies in a window whose word
sequence also starts earlier (smaller id, or same id and earlier place) is removed; windows are
judged on the input.

1. Prefilter.  Each window is stood for by its anchor, the smallest of the 13 hashes of eight
   words inside it, so neighbouring windows share anchors and the sketch holds about a seventh of
   the windows.  Equal windows have equal anchors at equal places, so the number of places of an
   anchor is never below the number of windows that it stands for.  Each task fills a count-min
   sketch of its rows; the sketches are merged chunk by chunk in the tasks that own the chunks.
   The merged sketch (two rows of ``counters`` two-bit counters that stop at 2) overestimates, and
   a window whose estimate is below 2 occurs once.
2. Second pass.  Windows estimated as repeated are hashed with 96 bits and dealt out in sorted
   ranges of (window, id), so that a window which a third of the texts share is spread over many
   tasks.  Each task lets go on what has a later id than the first with its window; of the window
   that a range starts with, the ranges before may hold the first, which the ends of all ranges
   tell.  Repeats inside one text are settled in its own task.
3. Starts of removed windows meet the texts by id, and the kept words are put together.

The sketch is sized by the corpus up to ``most_counters`` (then 2 * most_counters / 4 bytes are
broadcast, 32 MB at the default).  Beyond that more windows pass the filter, none is lost.

Defined cases: null texts have no words.  Texts under 20 words lose none.  Rows with a null id
lose only what repeats inside them and take nothing from others.  Rows repeated under one id with one text do not
remove each other, as neither starts earlier; with different texts under one id, only repeats
inside each text and of smaller ids count.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledger_jobs.llm.common import blocks, id_text, keep, record_batch
from ledger_jobs.llm.words import Words, grams, mix

WINDOW, ANCHOR = 20, 8
CHUNK = 1 << 16
U = np.uint64


def _slide(h: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over ``n`` consecutive places, for each first place."""
    width, cur = 1, h
    while 2 * width <= n:
        cur = pick(cur[: len(cur) - width], cur[width:])
        width *= 2
    gap = n - width
    return pick(cur[: len(cur) - gap], cur[gap:]) if gap else cur


class Windows:
    """Windows of a block of texts: ``at`` are the first words of whole windows, ``row`` their
    texts, ``anchor`` their anchors."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts)
        self.hash = w.hashes(0)
        n = len(w)
        row = np.repeat(np.arange(len(texts)), w.counts)
        whole = np.zeros(n, bool)
        if n >= WINDOW:
            whole[: n - WINDOW + 1] = row[: n - WINDOW + 1] == row[WINDOW - 1 :]
        self.at = np.flatnonzero(whole)
        self.row = row[self.at]
        if len(self.at):
            self.small = grams(self.hash, ANCHOR)
            least = _slide(self.small, WINDOW - ANCHOR + 1, np.minimum)
            self.anchor = least[self.at]
        else:
            self.small = self.anchor = np.zeros(0, np.uint64)

    def anchor_places(self) -> np.ndarray:
        """Hash of each place that is the anchor of some window, once per place."""
        if not len(self.at):
            return self.anchor
        reach = WINDOW - ANCHOR
        least = np.zeros(len(self.small) + reach, np.uint64)
        least[self.at + reach] = self.anchor
        return self.small[self.small == _slide(least, reach + 1, np.maximum)[: len(self.small)]]


def _slots(anchor: np.ndarray, counters: int) -> list[np.ndarray]:
    mask = U(counters - 1)
    return [(anchor & mask).astype(np.int64), (mix(anchor ^ U(0xA5A5A5A55A5A5A5A)) & mask).astype(np.int64)]


PARTIAL = pa.schema([("chunk", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
MERGED = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])


def _sketch_rows(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * counters, np.uint8)
        for batch in blocks(batches, "text"):
            for k, slot in enumerate(_slots(Windows(batch.column("text")).anchor_places(), counters)):
                at, n = np.unique(slot + k * counters, return_counts=True)
                seen[at] = np.minimum(seen[at] + np.minimum(n, 2), 2)
        for chunk in range(len(seen) // CHUNK):
            part = seen[chunk * CHUNK : (chunk + 1) * CHUNK]
            if part.any():
                once, more = (np.flatnonzero(part == k).astype("<u2").tobytes() for k in (1, 2))
                yield record_batch(PARTIAL, chunk=[chunk], once=[once], more=[more])

    return run


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the partial sketches of each chunk that this task owns, two bits a counter."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            total = sums.setdefault(row["chunk"], np.zeros(CHUNK, np.uint8))
            for name, by in (("once", 1), ("more", 2)):
                at = np.frombuffer(row[name], "<u2")
                total[at] = np.minimum(total[at] + by, 2)
    for chunk, total in sums.items():
        four = total.reshape(-1, 4)
        yield record_batch(MERGED, chunk=[chunk], counts=[(four << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()])


def sketch(texts: DataFrame, counters: int) -> np.ndarray:
    """The merged sketch as bytes of four counters; its size depends on ``counters`` only."""
    spark = texts.sparkSession
    partial = texts.select("text").mapInArrow(_sketch_rows(counters), "chunk int, once binary, more binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = partial.repartition(parts, "chunk").mapInArrow(_merge_rows, "chunk int, counts binary")
    out = np.zeros(2 * counters // 4, np.uint8)
    for row in merged.toLocalIterator():
        out[row.chunk * CHUNK // 4 : (row.chunk + 1) * CHUNK // 4] = np.frombuffer(row.counts, np.uint8)
    return out


def estimates(merged: np.ndarray, anchor: np.ndarray, counters: int) -> np.ndarray:
    """Count-min estimate of each anchor, 0 to 2."""
    out = np.full(len(anchor), 2, np.uint8)
    for k, slot in enumerate(_slots(anchor, counters)):
        at = slot + k * counters
        out = np.minimum(out, (merged[at >> 2] >> ((at & 3) << 1).astype(np.uint8)) & 3)
    return out


CANDIDATE = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("id", pa.int64()), ("start", pa.int32())])


def _candidate_rows(merged, counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            win = Windows(batch.column("text"))
            passed = np.flatnonzero(estimates(merged.value, win.anchor, counters) >= 2)
            if not len(passed):
                continue
            at, row = win.at[passed], win.row[passed]
            one, two = grams(win.hash, WINDOW)[at], (grams(win.words.hashes(1), WINDOW)[at] >> U(32)).astype(np.uint32)
            # of equal windows of one text the first goes on; the later ones are found again where words are removed
            _, first = np.unique(mix(one + row.astype(np.uint64) * U(0x9E3779B97F4A7C15)), return_index=True)
            first.sort()
            at, row = at[first], row[first]
            yield record_batch(
                CANDIDATE,
                h1=one[first].view(np.int64), h2=two[first].view(np.int32),
                id=batch.column("id").take(pa.array(row)), start=(at - win.words.first[row]).astype(np.int32),
            )

    return run


FOUND = pa.schema(
    [("id", pa.int64()), ("start", pa.int32()), ("part", pa.int32()), ("edge", pa.int8()), ("h1", pa.int64()), ("h2", pa.int32())]
)


def _later_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted candidates, those of a later id than the first with their window (edge 0).

    Whether the first rows of the task have an earlier id too, the tasks before know: these rows
    go out as edge 1, and the last window of the task as edge 2.
    """
    part = TaskContext.get().partitionId()
    last = head = low = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids = (np.asarray(batch.column(c)) for c in ("h1", "h2", "id"))
        if last is None:
            head, low = (h1[0], h2[0]), ids[0]
            last = (head, low)
        new = np.ones(len(ids), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = (h1[0], h2[0]) != last[0]
        group = np.cumsum(new)
        lows = np.concatenate(([last[1]], ids[new]))
        later = ids > lows[group]
        first = (~later) & (h1 == head[0]) & (h2 == head[1])
        last = ((h1[-1], h2[-1]), lows[group[-1]])
        for edge, rows in ((0, later), (1, first)):
            if rows.any():
                at = pa.array(np.flatnonzero(rows))
                n = len(at)
                yield record_batch(
                    FOUND, id=batch.column("id").take(at), start=batch.column("start").take(at), part=np.full(n, part),
                    edge=np.full(n, edge), h1=batch.column("h1").take(at), h2=batch.column("h2").take(at),
                )
    if last is not None:
        yield record_batch(FOUND, id=[None], start=[None], part=[part], edge=[2], h1=[last[0][0]], h2=[last[0][1]])


def removed_starts(texts: DataFrame, most_counters: int = 1 << 26) -> DataFrame:
    """(id, starts): windows of each text that a smaller id has too, by place of their first word."""
    texts = texts.filter("id IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = 1 << min(max(int(size // 12).bit_length(), 16), most_counters.bit_length() - 1)
    merged = texts.sparkSession.sparkContext.broadcast(sketch(texts, counters))
    passed = texts.mapInArrow(_candidate_rows(merged, counters), "h1 bigint, h2 int, id bigint, start int")
    found = keep(
        passed.repartitionByRange("h1", "h2", "id")
        .sortWithinPartitions("h1", "h2", "id")
        .mapInArrow(_later_rows, "id bigint, start int, part int, edge tinyint, h1 bigint, h2 int"),
        "repeated-windows",
    )
    ends = found.filter("edge = 2").select("h1", "h2", F.col("part").alias("before"))
    heads = found.filter("edge = 1").join(ends, ["h1", "h2"]).filter("before < part").select("id", "start").distinct()
    later = found.filter("edge = 0").select("id", "start").unionByName(heads)
    return later.groupBy("id").agg(F.collect_list("start").alias("starts"))


def _own_repeats(win: Windows) -> np.ndarray:
    """Windows that start again in the same text, by their first word in the block."""
    if not len(win.at):
        return win.at
    one = grams(win.hash, WINDOW)[win.at]
    key = np.sort(one_key := mix(one + win.row.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    some = np.flatnonzero(np.isin(one_key, key[1:][key[1:] == key[:-1]]))
    if not len(some):
        return some
    at, row, one = win.at[some], win.row[some], one[some]
    two = grams(win.words.hashes(1), WINDOW)[at]
    order = np.lexsort((at, two, one, row))
    at, row, one, two = at[order], row[order], one[order], two[order]
    return at[1:][(row[1:] == row[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])]


def covered(win: Windows, batch: pa.RecordBatch) -> np.ndarray:
    """For each word of the block, whether it goes."""
    lists = batch.column("starts")
    rows = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
    given = win.words.first[rows] + np.asarray(lists.flatten(), np.int64)
    depth = np.zeros(len(win.words) + WINDOW + 1, np.int64)
    for at in (given, _own_repeats(win)):
        np.add.at(depth, at, 1)
        np.add.at(depth, at + WINDOW, -1)
    return np.cumsum(depth)[: len(win.words)] > 0


def rewrite(df: DataFrame, starts: DataFrame, function, schema) -> DataFrame:
    """Runs ``function(batch, windows, gone)`` over blocks of the texts with their removed windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            win = Windows(batch.column("text"))
            yield from function(batch, win, covered(win, batch))

    return df.join(starts, "id", "left").mapInArrow(run, schema)


def n_removed(win: Windows, gone: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.append(gone, False).astype(np.int64), win.words.first[:-1]) * (win.words.counts > 0)


def cut(batch: pa.RecordBatch, win: Windows, gone: np.ndarray) -> list[str]:
    """The texts without the words that go; the white space before a removed word goes with it,
    all other characters stay as they are."""
    words, raw = win.words, win.words.raw
    keep_byte = np.ones(len(raw), bool)
    if gone.any():
        start = words.start.copy()
        start[1:] = words.end[:-1]
        firsts = words.first[:-1][words.counts > 0]
        start[firsts] = words.offsets[:-1][words.counts > 0]
        edge = np.zeros(len(raw) + 1, np.int64)
        np.add.at(edge, start[gone], 1)
        np.add.at(edge, words.end[gone], -1)
        keep_byte = np.cumsum(edge)[:-1] == 0
    return [
        raw[a:b][keep_byte[a:b]].tobytes().decode("utf-8") for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)
    ]


def joined_by_space(win: Windows, gone: np.ndarray) -> list[bytes]:
    """The words of each text that stay, joined by one space, in UTF-8."""
    words = win.words
    stay = np.flatnonzero(~gone)
    length = words.end[stay] - words.start[stay] + 1
    stop = np.cumsum(length)
    take = np.arange(stop[-1] if len(stop) else 0) + np.repeat(words.start[stay] - (stop - length), length)
    out = np.append(words.raw, np.uint8(32))[take]
    if len(stop):
        out[stop - 1] = 32
    bounds = np.concatenate(([0], stop))[np.searchsorted(stay, words.first)]
    data = out.tobytes()
    return [data[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256): what ``without_repeats`` keeps, as a digest."""
    texts = id_text(df, id_col, text_col)
    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def function(batch, win, gone):
        sha = [hashlib.sha256(kept).hexdigest() for kept in joined_by_space(win, gone)]
        yield record_batch(out, id=batch.column("id"), n_words=win.words.counts, n_removed=n_removed(win, gone), kept_sha256=sha)

    return rewrite(texts, removed_starts(texts, **sizes), function, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """``df`` with the repeated passages cut out of its texts; other columns stay as they are."""
    others = [c for c in df.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    texts = df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row.alias("row")
    )

    def function(batch, win, gone):
        at = batch.schema.get_field_index
        yield pa.RecordBatch.from_arrays([pa.array(cut(batch, win, gone), pa.string()), batch.column(at("row"))], ["text", "row"])

    schema = T.StructType([T.StructField("text", T.StringType()), texts.schema["row"]])
    done = rewrite(texts, removed_starts(texts.select("id", "text"), **sizes), function, schema)
    return done.select(*[F.col("text").alias(text_col) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])
