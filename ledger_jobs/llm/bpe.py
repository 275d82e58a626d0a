"""BPE encoding and decoding by prefix-sharing trie traversal.

Words are encoded per task: the distinct words that a block of texts adds form a trie, held as the
sorted words, and a depth-first walk carries each node's last token down.  The encoding of a prefix ends in
exactly one token t such that the encoding before t, followed by t, is again what the merges
give; whether two tokens may stand side by side is settled once per pair of tokens by merging
their symbols.  A node's last token and where it starts is all that its descendants need, so a
prefix shared by many words is encoded once, and a word is read off by going back from its leaf.

There is no shuffle: encodings stay in the task that meets the words, in a memo bounded by
``MEMO`` entries (it starts anew beyond that).  White space separates words in this vocabulary,
so each text is cut at white space, and normalising and pre-tokenising are done per distinct
piece by the tokenizer file's own rules.

Defined cases: null and empty texts give no tokens.  Strings of special tokens in a text are
matched as the tokenizers library matches them.  Rows are independent of each other, so ties,
repeats, null ids and extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledger_jobs.llm.common import blocks, id_text, record_batch

MEMO = 600_000
#: Unicode white space; Python's own split() also cuts at \x1c to \x1f, which are not.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NOT_WHITE = re.compile("[\x1c-\x1f]")
#: ASCII and the Latin letters that normalising leaves as they are but for case.
PLAIN = re.compile("[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*")
PLAIN_PIECE = re.compile("[!-@\\[-`{-~]+[^\\s!-@\\[-`{-~]*|[^\\s!-@\\[-`{-~]+")


class TrieBpe:
    """BPE vocabulary with merges by rank, encoding many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.vocab, self.suffix = vocab, suffix
        self.pairs, self.rank = pairs, {pair: k for k, pair in enumerate(pairs)}
        self.made = {a + b: k for k, (a, b) in reversed([*enumerate(pairs)])}
        self.alone: dict[str, bool] = {}
        self.longest = max(len(t) for t in vocab)
        self.beside: dict[tuple[str, str], bool] = {}

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.suffix]

    def parts(self, token: str) -> list[str]:
        """Symbols of a token; only its last one may carry the suffix."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            return self.symbols(token[: -len(self.suffix)])
        return list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        symbols = list(symbols)
        while len(symbols) > 1:
            k = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[k], symbols[k + 1]) not in self.rank:
                break
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def whole(self, token: str) -> bool:
        """Whether merging the symbols of ``token`` gives it."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = token in self.vocab and self.merge(self.parts(token)) == [token]
        return known

    def may_follow(self, left: str, right: str) -> bool:
        """Whether two whole tokens stay apart when they stand side by side.

        Undoing their last merges one by one shows which symbols met at the border, and until
        when; they are joined if a merge of the two ranks before that.  Of equal ranks the left
        one is first.
        """
        x, y, until = left, right, len(self.rank)
        while self.rank.get((x, y), until) >= until:
            made_x, made_y = self.made.get(x, -1), self.made.get(y, -1)
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                until, x = made_x, self.pairs[made_x][1]
            else:
                until, y = made_y + 1, self.pairs[made_y][0]
        return False

    def _settle(self, word: str, depth: int, path: list[tuple[str, int]], suffix: str) -> tuple[str, int]:
        """Last token of the prefix of ``depth`` symbols and where it starts; ``path`` has those of
        all shorter prefixes.  The token before, longer by a symbol, is tried first."""
        beside = self.beside
        if len(beside) > 3 * MEMO:
            beside.clear()
        likely = path[depth - 1][1] if depth > 1 else 0
        for start in (likely, *range(depth - 1, max(-1, depth - 1 - self.longest), -1)):
            token = word[start:depth] + suffix
            left = path[start][0]
            fits = beside.get((left, token))
            if fits is None:
                fits = beside[(left, token)] = self.whole(token) and (not left or self.may_follow(left, token))
            if fits:
                return token, start
        raise ValueError(f"no token ends at symbol {depth} of {word!r}")

    def encode(self, words: list[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word: a depth-first walk of the trie of all words, which is the
        sorted words with the lengths of the prefixes that neighbours share."""
        found: dict[str, list[str]] = {}
        path: list[tuple[str, int]] = [("", 0)]
        last = ""
        for word in sorted(words):
            shared, most = 0, min(len(path) - 1, len(word) - 1)
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del path[shared + 1 :]
            for depth in range(shared + 1, len(word)):
                path.append(self._settle(word, depth, path, ""))
            token, start = self._settle(word, len(word), path, self.suffix)
            tokens = [token]
            while start:
                token, start = path[start]
                tokens.append(token)
            found[word] = tokens[::-1]
            last = word
        return found


class TextBpe:
    """Texts to token ids and back by a tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.rules = Tokenizer.from_file(path)
        self.trie = TrieBpe(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token_ids = self.trie.vocab | self.special
        self.decimal = {t: str(i) for t, i in self.token_ids.items()}
        self.tokens = {i: t for t, i in self.token_ids.items()}
        self.memo: dict[str, tuple[int, bytes, bytes]] = {}

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that are encoded by themselves: cut at white space and, where all
        characters are ASCII or Latin letters, also between a letter and punctuation or a digit."""
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return PLAIN_PIECE.findall(text.lower())
        return [p for p in WHITE.split(text) if p] if NOT_WHITE.search(text) else text.split()

    def _words(self, pieces: list[str]) -> list[list[str]]:
        """Words and special tokens of each piece, by the rules of the file, in one call for all."""
        cut = [self.cut.split(p) if self.cut and self.cut.search(p) else [p] for p in pieces]
        plain = [part for parts in cut for part in parts if part and part not in self.special]
        joined = self.rules.normalizer.normalize_str(" ".join(plain))
        ends = np.cumsum([len(p) + 1 for p in joined.split(" ")])
        tokens = self.rules.pre_tokenizer.pre_tokenize_str(joined)
        owner = np.searchsorted(ends, [at for _, (at, _) in tokens], side="right").tolist()
        words: list[list[str]] = [[] for _ in plain]
        for (word, _), k in zip(tokens, owner, strict=True):
            words[k].append(word)
        rest = iter(words)
        return [[w for part in parts if part for w in ([part] if part in self.special else next(rest))] for parts in cut]

    def learn(self, pieces: list[str]) -> None:
        """Encodings of pieces not met before."""
        words = self._words(pieces)
        tokens = self.trie.encode([w for w in {w for ws in words for w in ws} if w not in self.special])
        for piece, ws in zip(pieces, words, strict=True):
            found = [t for w in ws for t in ([w] if w in self.special else tokens[w])]
            ids = " ".join([self.decimal[t] for t in found])
            self.memo[piece] = (len(found), ids.encode(), " ".join(found).encode())

    def encode_block(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """Number of tokens, decimal ids and decoded text of each text."""
        split = [self.pieces(t) for t in texts]
        here = set().union(*split)
        new = [p for p in here if p not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(here)
        if new:
            self.learn(new)
        memo = self.memo
        for pieces in split:
            rows = [memo[p] for p in pieces]
            yield sum(r[0] for r in rows), b" ".join([r[1] for r in rows if r[0]]), b" ".join([r[2] for r in rows if r[0]])

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as this file has no decoder."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=2)
def load(path: str) -> TextBpe:
    return TextBpe(path)


def _run(path: str, schema: pa.Schema, row):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in blocks(batches, "text", 1 << 20):
            rows = [row(*x) for x in bpe.encode_block(batch.column("text").to_pylist())]
            yield record_batch(schema, id=batch.column("id"), **dict(zip(schema.names[1:], map(list, zip(*rows, strict=True)), strict=True)))

    return run


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array, decoded): token ids of every text and what they decode to.

    ``path``: a tokenizers file whose pre-tokenizer drops white space, on every executor."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    function = _run(path, schema, lambda n, ids, text: ([int(i) for i in ids.split()], text.decode()))
    return id_text(df, id_col, text_col).mapInArrow(function, "id bigint, ids array<int>, decoded string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what ``encode`` gives."""
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    function = _run(path, schema, lambda n, ids, text: (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
    return id_text(df, id_col, text_col).mapInArrow(function, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
