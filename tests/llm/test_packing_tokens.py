"""Token ids of the packing operator against the tokenizers library, and what they cost."""

import random
import re
import time
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledger_jobs.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
FIELDS = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())]


@pytest.fixture
def piece_rows(monkeypatch):
    """The rows of a task over texts, at 1024 tokens a sequence."""
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = packing._piece_rows(PATH, 1024, 2, False, pa.schema(FIELDS))
    return lambda texts: pa.Table.from_batches(
        run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])])), pa.schema(FIELDS)
    )


PARTS = [
    "the", "Foo", "a", "is", "É", "ſ", "ß", "Ā", "ƀ", "×", "÷", "ª", "ж", "中", "é", "😀", " ", " ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c",
    "\x1f", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "'s", "'t", "'", "’", "1", "²", "٣", ".", ",", "!?", "_", "\x00", "\x7f",
    "<|endoftext|>", "<|", "|>", "endoftext",
]


@pytest.mark.parametrize("memo", [30, 1_000_000])
def test_ids_of_odd_texts(piece_rows, monkeypatch, memo):
    monkeypatch.setattr(packing, "MEMO", memo)
    packing.load.cache_clear()
    rnd, tok = random.Random(memo), Tokenizer.from_file(PATH)
    for n in (1, 2, 40, 400):
        texts = ["".join(rnd.choices(PARTS, k=rnd.choice([0, 1, 2, 6, 40]))) for _ in range(n)]
        texts += ["", "x" * 9000, "a b " * 900, texts[0]]
        want = []
        for k, text in enumerate(texts):
            ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
            want += [(k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for s, n in packing.pieces_of(len(ids), 1024)]
        got = piece_rows(texts).select(["id", "start", "length", "ids_crc32"]).to_pylist()
        assert [tuple(r.values()) for r in got] == want


def test_repeated_pieces_are_not_looked_up_one_by_one(piece_rows):
    """Texts of few distinct words take about as long as a plain loop that looks up each piece: 0.75
    times; with lookups piece by piece on top of that, it was twice as long."""
    rnd = random.Random(2)
    words = [" " + "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(5000)]
    texts = ["".join(rnd.choices(words, k=500)) for _ in range(2000)]
    ids = {w: b"1234" for w in words}

    def plain() -> None:
        for text in texts:
            b"".join(map(ids.__getitem__, re.findall(" [a-z]+", text)))

    def seconds(run) -> float:
        began = time.process_time()
        run()
        return time.process_time() - began

    piece_rows(texts)
    own, loop = (min(seconds(run) for _ in range(5)) for run in (lambda: piece_rows(texts), plain))
    assert own < 1.2 * loop, (own, loop)
