"""Best-fit packing by exact-complement hashing of lengths.

1. One pass tokenises the texts, a block at a time, cuts long ones into pieces, and numbers the
   pieces of each length within their task.  Pieces are written; token ids go along only when
   asked for.
2. The histogram of lengths (``capacity`` numbers, whatever the corpus) is all the planner needs.
   Single lengths, pairs and triples are indexed by their sums.  The gap that each longest piece
   leaves is looked up there, singles first, and what fills it exactly is consumed as often as the
   availability counts allow.  What remains is packed best-fit: the longest piece, then again and
   again the longest that still fits.
3. The plan says for each length which range of its pieces goes to which sequences.  A piece's
   place in that range is its number in its task plus the counts of earlier tasks, so nothing is
   sorted and a length that a third of all pieces share is no burden to one task.

Defined cases: null and empty texts are the end token alone, a piece of length 1.  Texts of
exactly the capacity are one piece.  Ties and repeated rows are separate pieces.  Null ids stay
null.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledger_jobs.llm.common import blocks, id_text, keep, record_batch, text_bytes

#: Distinct pieces that a task remembers, with at most 16 times as many token ids.
MEMO = 1_000_000
BLOCK = 1 << 22
#: ASCII and Latin letters: a run of them ends a pre-token whatever follows, and is one by itself
#: or with the blank before it.
LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])"
WORD = re.compile(rb" ?" + LETTER + rb"+")
#: White space; beside it, pre-tokens depend on more than the next word.
WIDE_WHITE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
BYTES = np.arange(256)
WHITE = np.isin(BYTES, [*b"\t\n\v\f\r\x1c\x1d\x1e\x1f "])
WIDE_LEAD = np.isin(BYTES, [0xC2, 0xE1, 0xE2, 0xE3])
ASCII_LETTER = np.isin(BYTES, [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
ASCII_OTHER = ~ASCII_LETTER & (BYTES < 128)
LATIN_LEAD = np.isin(BYTES, [0xC3, 0xC4, 0xC5])
#: The character that stands for each byte in byte-level vocabularies.
SHOWN = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
ALPHABET = "".join(chr(b if b in SHOWN else 256 + b - sum(x < b for x in SHOWN)) for b in range(256))


def places(text: bytes, part: bytes) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def cuts(raw: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Where pieces of the texts ``raw[offsets[k]:offsets[k + 1]]`` start, all in ascending order.

    A piece starts with each text, with a blank between two characters that are no white space, and
    where a letter is followed by an ASCII character that is none.  Texts that hold a special token
    are cut at blanks only.
    """
    white = WHITE[raw]
    high = raw >= 128
    letter = ASCII_LETTER[raw]
    if high.any():
        letter[1:] |= LATIN_LEAD[raw[:-1]] & ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))
        if WIDE_LEAD[raw].any():
            for found in WIDE_WHITE.finditer(raw.data):
                white[found.start() : found.end()] = True
    ends = np.zeros(len(raw), bool)
    ends[1:] = letter[:-1] & ASCII_OTHER[raw[1:]]
    whole = raw.tobytes() if special else b""
    for text in {int(np.searchsorted(offsets, at, side="right")) - 1 for s in special for at in places(whole, s)}:
        ends[offsets[text] : offsets[text + 1]] = False
    ends[1:-1] |= (raw[1:-1] == 0x20) & ~white[:-2] & ~white[2:]
    ends[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(ends)


class Encoder:
    """Token ids of texts, each with the end token after it, by a byte-level tokenizer file.

    Pre-tokens of such a vocabulary never reach over a blank between two other characters, nor
    from a letter into punctuation, so texts are cut there.  A block's pieces are told apart by
    Arrow's dictionary encoding; only distinct ones are looked up, and only new ones are given to
    the tokenizer.  All else is done on arrays.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        rule = spec["pre_tokenizer"] or {}
        plain = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule["add_prefix_space"]
        #: Whether a run of letters goes to the vocabulary as it is.
        self.words = plain and spec["normalizer"] is None and not any(map(WORD.fullmatch, self.special))
        self.end_id = end_id
        self._hold([b""], np.array([0, 1]), np.array([end_id], "<u4"))

    def _hold(self, pieces: list[bytes], bounds: np.ndarray, ids: np.ndarray) -> None:
        """Piece k of all that are remembered has the token ids ``ids[bounds[k]:bounds[k + 1]]``;
        piece 0 is the end of a text."""
        self.numbers = dict(zip(pieces, range(len(pieces)), strict=True))
        self.bounds, self.ids = bounds, ids

    def forget(self) -> None:
        """Keeps the later half of the pieces."""
        half = len(self.numbers) // 2 + 1
        bounds, ids = self.bounds[half:], self.ids[self.bounds[half] :]
        end = np.array([self.end_id], "<u4")
        self._hold([b"", *list(self.numbers)[half:]], np.append(0, bounds - bounds[0] + 1), np.concatenate((end, ids)))

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        words = [bool(self.words and WORD.fullmatch(p)) for p in pieces]
        rest = [p.decode() for p, word in zip(pieces, words, strict=True) if not word]
        found = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        tokens = self.tokenizer.model.tokenize
        shown = codecs.charmap_decode
        return [
            [t.id for t in tokens(shown(p, "strict", ALPHABET)[0])] if word else next(found).ids
            for p, word in zip(pieces, words, strict=True)
        ]

    def lookup(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of distinct pieces; those not remembered are learnt."""
        number = lambda: np.fromiter(map(self.numbers.get, pieces, repeat(-1)), np.int64, len(pieces))
        found = number()
        new = np.flatnonzero(found < 0)
        if len(self.numbers) + len(new) > MEMO or len(self.ids) > 16 * MEMO:
            self.forget()
            found = number()
            new = np.flatnonzero(found < 0)
        if len(new):
            words = [pieces[k] for k in new.tolist()]
            ids = self._ids(words)
            found[new] = np.arange(len(self.numbers), len(self.numbers) + len(new))
            self.numbers.update(zip(words, found[new].tolist(), strict=True))
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(lengths)))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(ids), "<u4", int(lengths.sum()))))
        return found

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and where those of each text begin; one more bound ends the last."""
        raw, offsets = text_bytes(texts)
        at = cuts(raw, offsets, self.special)
        bounds = pa.py_buffer(np.append(at, len(raw)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
        numbers = self.lookup(pieces.dictionary.to_pylist())[np.asarray(pieces.indices)]
        ends = np.searchsorted(at, offsets[1:])
        numbers = np.insert(numbers, ends, 0)
        first = self.bounds[numbers]
        lengths = self.bounds[numbers + 1] - first
        stops = np.cumsum(lengths)
        ids = self.ids[np.repeat(first - stops + lengths, lengths) + np.arange(stops[-1])]
        return ids, np.append(0, stops[ends + np.arange(len(ends))])


@lru_cache(maxsize=2)
def load(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _piece_rows(path: str, capacity: int, end_id: int, with_ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, end_id)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in blocks(batches, "text", BLOCK):
            ids = batch.column("id").to_pylist()
            found, bounds = encoder.encode_block(batch.column("text"))
            data, bounds = memoryview(found).cast("B"), (4 * bounds).tolist()
            rows = [
                (i, k, start, length, zlib.crc32(piece := data[at + 4 * start : at + 4 * (start + length)]), piece)
                for i, at, to in zip(ids, bounds, bounds[1:], strict=False)
                for k, (start, length) in enumerate(pieces_of((to - at) // 4, capacity))
            ]
            id_, piece, start, length, crc, data = zip(*rows, strict=True)
            lengths = np.array(length)
            order = np.argsort(lengths, kind="stable")
            counts = np.bincount(lengths, minlength=capacity + 1)
            rank = np.empty(len(rows), np.int64)
            rank[order] = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            rank += seen[lengths]
            seen += counts
            more = {"ids": list(map(bytes, data))} if with_ids else {}
            yield record_batch(
                schema, id=list(id_), piece=list(piece), start=list(start), length=lengths, ids_crc32=list(crc),
                part=np.full(len(rows), part), rank=rank, **more,
            )

    return run


class SumIndex:
    """Lengths in use by what they sum to: singles, pairs and triples, each with the longest first.

    Pairs are listed once, sorted by their sum; the triples of a sum are its lengths joined with
    the pairs of the rest, so only the bucket that is looked up is ever laid out, without the
    lengths that none is ``left`` of.
    """

    def __init__(self, lengths: np.ndarray, most: int):
        self.lengths = lengths = np.sort(lengths[lengths < most])
        a, b = np.tril_indices(len(lengths))
        a, b = lengths[a], lengths[b]
        fits = a + b < most
        a, b = a[fits], b[fits]
        order = np.lexsort((-a, a + b))
        self.pair = np.stack((a, b), axis=1)[order]
        self.bounds = np.searchsorted((a + b)[order], np.arange(most + 1))

    def singles(self, total: int, left: list[int]) -> Iterator[np.ndarray]:
        yield self.lengths[self.lengths == total][:, None]

    def pairs(self, total: int, left: list[int]) -> Iterator[np.ndarray]:
        yield self.pair[self.bounds[total] : self.bounds[total + 1]]

    def triples(self, total: int, left: list[int]) -> Iterator[np.ndarray]:
        for x in self.lengths[(3 * self.lengths >= total) & (self.lengths < total)][::-1].tolist():
            if not left[x]:
                continue
            rest = self.pair[self.bounds[total - x] : self.bounds[total - x + 1]]
            rest = rest[rest[:, 0] <= x]
            yield np.column_stack((np.full(len(rest), x), rest))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (times, [(length, how many)]) that use up the counts; times * sums fit capacity.

    Exact triples and pairs can leave lengths behind that pack badly when there are few pieces;
    so singles, up to pairs and up to triples are each tried, and the best plan is taken.
    """
    index = SumIndex(np.array(sorted(counts), np.int64), capacity)
    tables = (index.singles, index.pairs, index.triples)
    return min((_plan(counts, capacity, tables[:n]) for n in (3, 2, 1)), key=lambda p: sum(times for times, _ in p))


def _plan(counts: dict[int, int], capacity: int, tables) -> list[tuple[int, list[tuple[int, int]]]]:
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[int, list[tuple[int, int]]]] = []

    def take(lengths: list[int]) -> None:
        need = sorted({x: lengths.count(x) for x in lengths}.items(), reverse=True)
        if times := min(left[x] // m for x, m in need):
            for x, m in need:
                left[x] -= times * m
            out.append((times, need))

    if left[capacity]:
        take([capacity])
    for table in tables:
        for head in range(capacity - 1, 0, -1):
            if not left[head]:
                continue
            for found in table(capacity - head, left):
                if not left[head]:
                    break
                for lengths in found[found[:, 0] <= head].tolist():
                    if left[head] and all(left[x] for x in lengths):
                        take([head, *lengths])
    rest = np.array(left)
    while rest.any():
        lengths, gap, spare = [], capacity, rest.copy()
        while gap and (fits := np.flatnonzero(spare[: gap + 1])).size:
            x = int(fits[-1])
            lengths.append(x)
            spare[x] -= 1
            gap -= x
        take(lengths)
        for x in lengths:
            rest[x] = left[x]
    return out


def plan_rows(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first piece, how many in a sequence, first sequence, offset), by length and piece."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, need in patterns:
        offset = 0
        for length, m in need:
            rows.append((length, used.get(length, 0), m, sequence, offset))
            used[length] = used.get(length, 0) + times * m
            offset += length * m
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed_rows(sent, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        keys = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, number = (np.asarray(batch.column(c), np.int64) for c in ("length", "number"))
            row = rows[np.searchsorted(keys, (length << 48) + number, side="right") - 1]
            turn, place = np.divmod(number - row[:, 1], row[:, 2])
            found = {"sequence_id": row[:, 3] + turn, "offset": row[:, 4] + place * length}
            yield record_batch(schema, **{n: found[n] if n in found else batch.column(n) for n in schema.names})

    return run


def pack(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and with
    ``with_ids`` its token ids as little-endian 32-bit bytes.  ``path``: a byte-level tokenizers
    file, on every executor."""
    extra = [("ids", pa.binary())] if with_ids else []
    common = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    ddl = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema = pa.schema([*common, ("part", pa.int32()), ("rank", pa.int64()), *extra])
    cut = keep(
        id_text(df, id_col, text_col).mapInArrow(
            _piece_rows(path, capacity, end_id, with_ids, schema), f"{ddl}, part int, rank bigint" + ", ids binary" * with_ids
        ),
        "pieces",
    )
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(bases, ["part", "length"]).withColumn("number", F.col("base") + F.col("rank")).drop("base", "rank", "part")
    out = pa.schema([*common, *extra, ("sequence_id", pa.int64()), ("offset", pa.int64())])
    rows = df.sparkSession.sparkContext.broadcast(plan_rows(plan(histogram, capacity)))  # a few rows per pattern of lengths
    return numbered.mapInArrow(
        _placed_rows(rows, out), ddl + ", ids binary" * with_ids + ", sequence_id bigint, offset bigint"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from ``pack(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform("parts", lambda p: F.hex(p.ids)), F.lit(""), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.unhex(joined).alias("ids"))
