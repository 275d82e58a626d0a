"""Fill-in-middle by secondary sort: pieces of a text are dealt by document and sorted by output place.

1. A text is cut at two code points into prefix, middle and suffix, and these into pieces of
   ``PIECE`` code points.  A piece is keyed by its document and its place in the output; the markers
   stand before the first piece of their part.
2. Pieces are dealt by document and sorted by place within their partition (repartition and sort in
   one exchange).  A task streams them into the digest of the output; no output is put together.
3. From that stream alone, with the document's form, the markers are found again, and what lies
   between them is handed on under its place in the text.  A second sort of the partition, without
   an exchange, brings the pieces back in order, and they are streamed into the digest of the text.

So a task holds one input text while cutting it, and a batch of pieces from then on, however long a
document is.  The key is (id, digest of the text, partition of the input): ids given to several texts
stay apart, copies of one row within a partition are counted at their first piece, and rows that
repeat very often are spread over as many tasks as they come from.

Defined cases: a null text is empty; a null id is cut like one without digits.  Extra columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_jobs.llm.common import id_text

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Code points of a piece; bytes and rows of an Arrow batch of pieces.
PIECE, BATCH_BYTES, BATCH_ROWS = 1 << 14, 1 << 20, 8192
#: In a hundred: texts left plain from, and texts with the suffix first below.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Parts of each form in the order of the output, with their place in the text.
PARTS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
#: Places of a part begin at multiples of this.
_PART = 1 << 40

_KEY = "id bigint, mark binary, part int, place bigint"
PIECES = f"{_KEY}, piece binary, form string, n bigint, prefix_chars bigint, middle_chars bigint"
RESTORED = f"{PIECES}, copies bigint, output_sha256 string"
DIGESTS = "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
OUTPUTS = "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def cuts(id_: int | None, text: str) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a text, drawn from its id."""
    seed = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(seed[8 * k : 8 * k + 8], 16) for k in range(4)]
    marked = any(m.decode() in text for m in (PREFIX, SUFFIX, MIDDLE))
    one, two = h[0] % (len(text) + 1), h[1] % (len(text) + 1)
    form = "plain" if not text or marked or h[2] % 100 >= PLAIN_FROM else "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"
    return form, min(one, two), max(one, two)


def _batches(rows: Iterator[tuple], schema: str, sized: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows, with at most about ``BATCH_BYTES`` in the column ``sized``."""
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    size = 0
    for row in rows:
        held.append(row)
        size += len(row[sized] or b"")
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for some in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
            yield from zip(*(c.to_pylist() for c in some.columns), strict=True)


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Rows of ``PIECES`` of (id, text, part), in any order."""
    for id_, text, part in _rows(batches):
        mark = hashlib.blake2b(text.encode(), digest_size=16).digest()
        form, one, two = cuts(id_, text)
        plain = form == "plain"
        about = (form, len(text), None if plain else one, None if plain else two - one)
        ends = ((0, one), (one, two), (two, len(text)))
        for k, (marker, of) in enumerate(((b"", None),) if plain else PARTS[form]):
            start, stop = (0, len(text)) if plain else ends[of]
            for at in range(start, max(stop, start + 1), size):
                first, piece = at == start, text[at : min(at + size, stop)].encode()
                yield id_, mark, part, k * _PART + at - start, (marker + piece if first else piece), *(about if first and k == 0 else (None,) * 4)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PIECE) -> DataFrame:
    """Pieces of at most ``size`` code points in the order of the output within their partition,
    which holds whole documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_cut(batches, size), PIECES, 4)

    texts = id_text(df, id_col, text_col).withColumn("part", F.spark_partition_id())
    keys = ["id", "mark", "part"]
    return texts.mapInArrow(cut, PIECES).repartition(*keys).sortWithinPartitions(*keys, "place")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    for key, rows in groupby(_rows(batches), key=lambda r: r[:3]):
        yield key, rows


def _once(rows: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
    """One piece for each place, and how many copies of it there are."""
    for _, same in groupby(rows, key=lambda r: r[3]):
        first = next(same)
        yield first, 1 + sum(1 for _ in same)


def restoring(form: str, stream: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(part of the text, bytes) of an output that comes in pieces of any size: markers are looked
    for in the stream itself, also where they lie across pieces."""
    if form == "plain":
        yield from ((0, piece) for piece in stream)
        return
    ahead, part, left = list(PARTS[form]), None, b""
    for piece in stream:
        left += piece
        while ahead and (at := left.find(ahead[0][0])) >= 0:
            if at:
                yield part, left[:at]
            left, part = left[at + len(ahead[0][0]) :], ahead.pop(0)[1]
        safe = max(0, len(left) - len(PREFIX) + 1) if ahead else len(left)
        if safe:
            yield part, left[:safe]
            left = left[safe:]
    if left:
        yield part, left


def _stream_output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for key, group in _documents(batches):
            once = _once(group)
            head, copies = next(once)
            digest = hashlib.sha256()

            def stream(first=head[4], rest=once, digest=digest) -> Iterator[bytes]:
                digest.update(first)
                yield first
                for row, _ in rest:
                    digest.update(row[4])
                    yield row[4]

            for at, (part, piece) in enumerate(restoring(head[5], stream())):
                yield *key, part * _PART + at, piece, *(None,) * 6
            yield *key, -1, b"", *head[5:9], copies, digest.hexdigest()

    return _batches(rows(), RESTORED, 4)


def _stream_restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for key, group in _documents(batches):
            _, _, _, _, _, form, n, prefix, middle, copies, output = next(group)
            digest = hashlib.sha256()
            for row in group:
                digest.update(row[4])
            for _ in range(copies):
                yield key[0], n, form, prefix, middle, output, digest.hexdigest()

    return _batches(rows(), DIGESTS, 5)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PIECE) -> DataFrame:
    """One row per row of ``df``: id, n, form, prefix_chars, middle_chars (code points), the digest
    of the output, and that of the text rebuilt from output and form."""
    back = pieces(df, id_col, text_col, size).mapInArrow(_stream_output, RESTORED)
    return back.sortWithinPartitions("id", "mark", "part", "place").mapInArrow(_stream_restored, DIGESTS)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for key, group in _documents(batches):
            once = _once(group)
            head, copies = next(once)
            output = b"".join([head[4], *(row[4] for row, _ in once)]).decode()
            form, n, prefix, middle = head[5:9]
            for _ in range(copies):
                yield key[0], n, form, prefix, middle, output

    return _batches(rows(), OUTPUTS, 5)


def outputs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``, with the transformed text itself, which a task holds whole."""
    return pieces(df, id_col, text_col).mapInArrow(_join, OUTPUTS)
