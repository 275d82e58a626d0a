"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

1. A bounded sample of labelled documents (``most_toxic`` and ``most_clean`` distinct texts, by a
   hash of their ids) is joined to the texts by broadcast, so texts are not shuffled.
2. Labels mark documents; tokens get theirs from the sample: how much more often a feature (a
   word, or its first four to seven bytes) occurs in toxic than in clean documents.  In toxic
   documents, tokens with a strongly toxic feature are labelled 1, all others 0.
3. The field has one weight per feature of a vocabulary of ``VOCAB`` (the most telling ones), a
   bias, starts and transitions.  Each round, tasks add up the gradient of the log-likelihood over
   their part of the sample by forward-backward; the driver, holding the weights only, takes an
   AdaGrad step.
4. Every text is tagged by one pass without shuffle.  Forward-backward runs over all tokens of a
   block at once: products of 2x2 matrices in chunks, and a reset where a text starts.
   The largest marginal, the expected number of toxic tokens and the length give the score, by a
   logistic calibration on the sample that is weighted back to the true share of toxic documents;
   runs of tokens with high marginals are the offending spans, in characters of the source.

The vocabulary is bounded (``VOCAB`` features): it describes the bounded sample, not the corpus, and
rarer features of the sample are the ones left out.

Defined cases: null and empty texts have no tokens and are scored by the calibration as a text
without toxic tokens.  Labels with a null id or value are ignored; several labels of one id count
as toxic if one does.  Without toxic or without clean labels every score is 0.  Rows with a null
id are scored like others.  Rows are independent of each other once the model is there, so ties,
repeats and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_jobs.llm.common import blocks, id_text, keep, record_batch
from ledger_jobs.llm.words import Words, mix

VOCAB, TABLE_BITS, PREFIXES = 1 << 15, 20, (4, 5, 6, 7)
ROUNDS, RATE, DECAY = 14, 1.0, 1e-4
#: Documents with a feature, and log odds of it, from which a token that has it is labelled toxic.
LEAST_DOCS, LEAST_ODDS = 3, 3.5
U = np.uint64
_NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words (letters and digits, lower case) and the hashes of the features of each."""
    words = Words(pc.utf8_lower(texts), space=_NOT_ALNUM)
    length = words.end - words.start
    cols = [words.hashes()] + [np.where(length > k, mix(words.hashes(most=k) + U(k)), U(0)) for k in PREFIXES]
    return words, np.stack(cols, axis=1)


class Vocabulary:
    """Index of each known feature; unknown ones get the index ``VOCAB``, whose weight stays 0."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.zeros(VOCAB + 1, np.uint64)
        self.hashes[: len(hashes)] = hashes
        self.table = np.full((2, 1 << TABLE_BITS), VOCAB, np.int32)
        at = np.arange(len(hashes), dtype=np.int32)
        for row, slot in enumerate(self._slots(hashes)):
            self.table[row, slot] = at

    @staticmethod
    def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h >> U(64 - TABLE_BITS), h & U((1 << TABLE_BITS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        one, two = (self.table[row, slot] for row, slot in enumerate(self._slots(h)))
        out = np.where(self.hashes[one] == h, one, np.where(self.hashes[two] == h, two, VOCAB))
        return np.where(h == 0, VOCAB, out)


@dataclass
class Field:
    """Weights of the chain: features, bias, transitions (2, 2), starts (2)."""

    weight: np.ndarray
    bias: float
    move: np.ndarray
    begin: np.ndarray

    @classmethod
    def empty(cls) -> Field:
        return cls(np.zeros(VOCAB + 1), -1.0, np.zeros((2, 2)), np.zeros(2))

    def flat(self) -> np.ndarray:
        return np.concatenate((self.weight, [self.bias], self.move.ravel(), self.begin))

    @classmethod
    def of(cls, x: np.ndarray) -> Field:
        n = VOCAB + 1
        return cls(x[:n].copy(), float(x[n]), x[n + 1 : n + 5].reshape(2, 2).copy(), x[n + 5 :].copy())


class Chain:
    """Forward-backward over the tokens of many texts, one after the other."""

    def __init__(self, unary: np.ndarray, first: np.ndarray, field: Field):
        n = self.n = len(unary)
        toxic = np.exp(np.clip(unary, -30, 30))
        stay, begin = np.exp(np.clip(field.move, -15, 15)), np.exp(np.clip(field.begin, -15, 15))
        steps = max(1, int(np.sqrt(n)))
        chunks = -(-n // steps)
        m = np.zeros((4, chunks * steps))
        m[0, n:] = m[3, n:] = 1.0
        for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            m[k, :n] = np.where(first, begin[b], stay[a, b]) * (toxic if b else 1.0)
        self.m = m[:, :n]
        m = np.ascontiguousarray(m.reshape(4, chunks, steps).transpose(2, 0, 1))  # step, entry, chunk
        before = np.empty_like(m)
        before[0] = m[0]
        for k in range(1, steps):
            before[k] = self._times(before[k - 1], m[k])
        after = np.empty_like(m)
        after[-1] = np.array([1.0, 0.0, 0.0, 1.0])[:, None]
        for k in range(steps - 2, -1, -1):
            after[k] = self._times(m[k + 1], after[k + 1])
        whole = before[-1]
        enter, leave = np.ones((2, chunks)), np.ones((2, chunks))
        for c in range(1, chunks):
            a, b = enter[:, c - 1]
            w = whole[:, c - 1]
            v = np.array([a * w[0] + b * w[2], a * w[1] + b * w[3]])
            enter[:, c] = v / v.max()
        for c in range(chunks - 2, -1, -1):
            a, b = leave[:, c + 1]
            w = whole[:, c + 1]
            v = np.array([w[0] * a + w[1] * b, w[2] * a + w[3] * b])
            leave[:, c] = v / v.max()
        flat = lambda x: x.T.ravel()[:n]
        self.alpha = np.stack([flat(enter[0] * before[:, j] + enter[1] * before[:, 2 + j]) for j in (0, 1)])
        self.beta = np.stack([flat(after[:, 2 * j] * leave[0] + after[:, 2 * j + 1] * leave[1]) for j in (0, 1)])
        both = self.alpha * self.beta
        self.marginal = both[1] / (both[0] + both[1])

    @staticmethod
    def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.stack((x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3], x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3]))
        return out / out.max(axis=0)

    def moves(self, first: np.ndarray) -> np.ndarray:
        """Expected number of each transition inside texts."""
        at = np.flatnonzero(~first)
        pair = np.stack([self.alpha[a, at - 1] * self.m[2 * a + b, at] * self.beta[b, at] for a in (0, 1) for b in (0, 1)])
        return (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)


def starts_of(words: Words) -> np.ndarray:
    first = np.zeros(len(words), bool)
    first[words.first[:-1][words.counts > 0]] = True
    return first


COUNTS = pa.schema([("feature", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by label; once per document."""
    for batch in blocks(batches, "text"):
        words, h = features(batch.column("text"))
        row = np.repeat(np.arange(batch.num_rows), words.counts)
        pairs = np.unique(np.stack((np.repeat(row, h.shape[1]).astype(np.uint64), h.ravel()), axis=1), axis=0)
        pairs = pairs[pairs[:, 1] != 0]
        label = np.asarray(batch.column("toxic"))[pairs[:, 0].astype(np.int64)]
        found, at = np.unique(pairs[:, 1], return_inverse=True)
        toxic, every = np.bincount(at, label, len(found)).astype(np.int64), np.bincount(at, minlength=len(found))
        yield record_batch(COUNTS, feature=found.view(np.int64), toxic=toxic, clean=every - toxic)


def odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))


GRADIENT = pa.schema([("gradient", pa.binary())])


def _gradient_rows(field: Field, vocabulary: Vocabulary, tell: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCAB + 8)
        for batch in blocks(batches, "text"):
            words, h = features(batch.column("text"))
            if not len(words):
                continue
            at, first = vocabulary.find(h), starts_of(words)
            label = tell[at].any(axis=1) & (np.repeat(np.asarray(batch.column("toxic")), words.counts) == 1)
            chain = Chain(field.weight[at].sum(axis=1) + field.bias, first, field)
            error = label - chain.marginal
            total[: VOCAB + 1] += np.bincount(at.ravel(), np.repeat(error, at.shape[1]), VOCAB + 1)
            total[VOCAB + 1] += error.sum()
            y = label.astype(np.int64)
            inside = np.flatnonzero(~first)
            seen = np.bincount(2 * y[inside - 1] + y[inside], minlength=4).reshape(2, 2)
            total[VOCAB + 2 : VOCAB + 6] += (seen - chain.moves(first)).ravel()
            total[VOCAB + 7] += error[first].sum()
            total[VOCAB + 6] -= error[first].sum()
        yield record_batch(GRADIENT, gradient=[total.tobytes()])

    return run


STATS = ("peak", "mass", "n")


def document_stats(marginal: np.ndarray, words: Words) -> np.ndarray:
    """Largest marginal, sum of marginals and number of words of each text."""
    out = np.zeros((len(words.counts), 3))
    full = np.flatnonzero(words.counts)
    if len(full):
        starts = words.first[:-1][full]
        out[full, 0] = np.maximum.reduceat(marginal, starts)
        out[full, 1] = np.add.reduceat(marginal, starts)
    out[:, 2] = words.counts
    return out


def inputs(stats: np.ndarray) -> np.ndarray:
    """What the calibration sees of (peak, mass, n)."""
    peak = np.clip(stats[:, 0], 1e-6, 1 - 1e-6)
    return np.stack((np.ones(len(stats)), np.log(peak / (1 - peak)) / 5, np.log1p(stats[:, 1]), np.log1p(stats[:, 2]) / 5), axis=1)


def calibrate(stats: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x, w = inputs(stats), np.zeros(4)
    ridge = np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (toxic - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
    return w


@dataclass
class Model:
    """What is sent to tasks; its size does not depend on the data."""

    vocabulary: Vocabulary
    field: Field
    calibration: np.ndarray

    def marginals(self, texts: pa.Array) -> tuple[Words, np.ndarray]:
        words, h = features(texts)
        if not len(words):
            return words, np.zeros(0)
        unary = self.field.weight[self.vocabulary.find(h)].sum(axis=1) + self.field.bias
        return words, Chain(unary, starts_of(words), self.field).marginal

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(stats) @ self.calibration, -30, 30)))


def sample(texts: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of a bounded sample of distinct labelled texts, and for each label how many
    labelled documents one of the sample stands for."""
    labels = labels.filter("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    taken = [
        labels.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k, most in ((1, most_toxic), (0, most_clean))
    ]
    chosen = keep(taken[0].unionByName(taken[1]), "label-sample")
    joined = texts.join(F.broadcast(chosen), "id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    out = keep(joined.repartition(12, F.xxhash64("text")), "toxicity-sample")
    sizes = {r.toxic: r.n for r in out.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return out, {k: totals.get(k, 0) / n for k, n in sizes.items()}


def train(texts: DataFrame, labels: DataFrame, most_toxic: int = 3000, most_clean: int = 5000) -> Model | None:
    """A model from (id, text) and (id, toxic); None without labels of both kinds."""
    docs, shares = sample(texts, labels, most_toxic, most_clean)
    if not shares.get(0) or not shares.get(1):
        return None
    sizes = {r.toxic: r.n for r in docs.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = docs.mapInArrow(_count_rows, "feature bigint, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lean = odds(F.col("toxic"), F.col("clean"), sizes[1], sizes[0])
    telling = (
        counts.filter(F.col("toxic") + F.col("clean") >= LEAST_DOCS)
        .withColumn("odds", lean)
        .orderBy(F.desc(F.abs("odds") * F.sqrt(F.least(F.col("toxic") + F.col("clean"), F.lit(100)))), "feature")
        .limit(VOCAB)
        .collect()
    )
    vocabulary = Vocabulary(np.array([r.feature for r in telling], np.int64).view(np.uint64))
    tell = np.zeros(VOCAB + 1, bool)
    tell[: len(telling)] = [r.odds >= LEAST_ODDS and r.toxic >= LEAST_DOCS for r in telling]
    x = Field.empty().flat()
    squares = np.full(len(x), 1e-8)
    send = docs.sparkSession.sparkContext.broadcast
    known = send((vocabulary, tell))
    for _ in range(ROUNDS):
        now = send(Field.of(x))
        parts = docs.mapInArrow(lambda it, now=now: _gradient_rows(now.value, *known.value)(it), "gradient binary").collect()
        gradient = np.sum([np.frombuffer(p.gradient) for p in parts], axis=0) / docs_scale(sizes) - DECAY * x
        squares += gradient**2
        x += RATE * gradient / np.sqrt(squares)
        x[VOCAB] = 0.0
        now.unpersist()
    model = Model(vocabulary, Field.of(x), np.zeros(4))
    rows = docs.mapInArrow(_stat_rows(send(model)), "toxic int, peak double, mass double, n double").collect()
    data = np.array([tuple(r) for r in rows], np.float64)
    weight = np.where(data[:, 0] == 1, shares[1], shares[0])
    model.calibration = calibrate(data[:, 1:], data[:, 0], weight / weight.mean())
    return model


def docs_scale(sizes: dict[int, int]) -> int:
    return sum(sizes.values())


def _stat_rows(model):
    schema = pa.schema([("toxic", pa.int32()), *((s, pa.float64()) for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            words, marginal = model.value.marginals(batch.column("text"))
            stats = document_stats(marginal, words)
            yield record_batch(schema, toxic=batch.column("toxic"), **dict(zip(STATS, stats.T, strict=True)))

    return run


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
SPAN_DDL = "array<struct<start: int, end: int, score: double>>"


def offending(words: Words, marginal: np.ndarray, least: float) -> pa.Array:
    """For each text the runs of words with marginals of at least ``least``: first character, the
    one after the last, and the largest marginal.

    Lower case is taken character by character, so characters of the lower-cased text, in which
    words were found, are counted as those of the source.
    """
    toxic, first = marginal >= least, starts_of(words)
    opens = np.flatnonzero(toxic & (first | ~np.concatenate(([False], toxic[:-1]))))
    shuts = np.flatnonzero(toxic & (np.append(first[1:], True) | ~np.append(toxic[1:], False)))
    row = np.searchsorted(words.first, opens, side="right") - 1
    chars = np.concatenate(([0], np.cumsum((words.raw & 0xC0) != 0x80)))
    base = chars[words.offsets[row]]
    peak = np.maximum.reduceat(np.append(np.where(toxic, marginal, 0), 0), opens) if len(opens) else np.zeros(0)
    parts = [pa.array((chars[words.start[opens]] - base).astype(np.int32)), pa.array((chars[words.end[shuts]] - base).astype(np.int32)), pa.array(peak)]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(words.counts)))))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(parts, fields=list(SPAN)))


def scores(
    df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, least: float = 0.5
) -> DataFrame:
    """(id, score, predicted, spans) of every text.  ``spans`` are its toxic runs of words, with
    marginals of at least ``least``, as (start, end, score) in characters of the text: a span is
    ``substring(text, start + 1, end - start)``."""
    texts = id_text(df, id_col, text_col)
    if model is None:
        return texts.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(SPAN_DDL).alias("spans"))
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(SPAN))])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            words, marginal = sent.value.marginals(batch.column("text"))
            score = sent.value.score(document_stats(marginal, words))
            yield record_batch(schema, id=batch.column("id"), score=score, predicted=score >= cut, spans=offending(words, marginal, least))

    return texts.mapInArrow(run, f"id bigint, score double, predicted int, spans {SPAN_DDL}")


def without_toxic(df: DataFrame, model: Model | None, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose texts score below ``cut``, with all their columns."""
    if model is None:
        return df
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            words, marginal = sent.value.marginals(batch.column(text_col).fill_null(""))
            clean = sent.value.score(document_stats(marginal, words)) < cut
            if clean.any():
                yield batch.filter(pa.array(clean))

    return df.mapInArrow(run, df.schema)


def held_out(id_: Column) -> Column:
    """Documents whose labels are kept from training: a quarter, by a checksum of the id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(documents: DataFrame, labels: DataFrame, **bounds) -> Model | None:
    """A model from tables with doc_id, text and doc_id, toxic, without the held-out quarter."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").filter(~held_out(F.col("id")))
    return train(id_text(documents, "doc_id", "text"), known, **bounds)
