"""Ways that only large groups and large inputs take, forced on small ones; recall of the lattice on
planted vectors; op1 and op8 against brute force on a given table."""

import hashlib
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from ledger_jobs.llm import lattice, minhash, toxicity, warc
from ledger_jobs.llm.queries import op1_substring_dedup, op8_minhash

GIVEN = "/root/testdata/sf0.01"


def planted(rng, cosine, pairs, dim):
    """Unit vectors, pair by pair, with a given cosine."""
    one, other = rng.normal(size=(2, pairs, dim))
    one /= np.linalg.norm(one, axis=1)[:, None]
    other -= (one * other).sum(1)[:, None] * one
    other /= np.linalg.norm(other, axis=1)[:, None]
    return np.stack((one, cosine * one + np.sqrt(1 - cosine**2) * other), axis=1).reshape(-1, dim)


@pytest.mark.parametrize(("cosine", "least"), [(0.901, 0.96), (0.92, 0.985), (0.95, 0.999)])
def test_lattice_recall_of_planted_pairs(spark, cosine, least):
    """64 components, as in the given embeddings, which hold no pair of 0.9 themselves."""
    pairs = 1500
    vecs = planted(np.random.default_rng(5), cosine, pairs, 64)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "vec_id bigint, embedding array<double>").repartition(4)
    got = {r.id: (r.n_links, r.component) for r in lattice.near_vectors(table).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    near = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))
    assert len(near) == pairs
    found = [got[int(b)] == (1, int(a)) and got[int(a)] == (1, int(a)) for a, b in near]
    assert np.mean(found) >= least and sum(n for n, _ in got.values()) == 2 * sum(found)


@pytest.mark.parametrize("block", [7, 25])
def test_lattice_cells_of_many_blocks(spark, monkeypatch, block):
    """No link is counted twice, and none that one block per cell finds is lost."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6, 64))
    vecs = np.concatenate([b + s * rng.normal(size=(40, 64)) for b, s in zip(base, (0.05, 0.1, 0.15, 0.2, 0.25, 0.3), strict=True)])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "vec_id bigint, embedding array<double>").repartition(4)
    want = {r.id: (r.n_links, r.component) for r in lattice.near_vectors(table).collect()}
    monkeypatch.setattr(lattice, "BLOCK", block)
    assert {r.id: (r.n_links, r.component) for r in lattice.near_vectors(table).collect()} == want
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    true = (unit @ unit.T >= 0.9).sum(1) - 1
    assert all(want[k][0] <= n for k, n in enumerate(true.tolist())) and sum(n for n, _ in want.values()) >= 0.97 * true.sum()


def components_of(sets, percent):
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
            continue
        both = len(x & y)
        if 100 * both >= percent * (len(x) + len(y) - both):
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {i: top(i) for i in sets}


def test_minhash_buckets_of_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(150):
        words = list(base)
        for at in rng.integers(0, 40, rng.integers(0, 4)):
            words[at] = f"x{rng.integers(0, 9)}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(minhash, "STRAYS", 2)
    monkeypatch.setattr(minhash, "MEMBERS", 3)
    monkeypatch.setattr(minhash, "LEADERS", 1)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.id: r.component for r in minhash.near_groups(table, size=2, percent=80).collect()}
    sets = {i: {tuple(w[k : k + 2]) for k in range(39)} for i, w in ((i, t.split()) for i, t in rows)}
    assert got == components_of(sets, 80)


needs_tables = pytest.mark.skipif(not Path(GIVEN).exists(), reason="given tables are absent")


@needs_tables
def test_minhash_on_given_documents(spark):
    rows = spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for i, text in rows:
        w = [x.lower() for x in (text or "").encode().split()]
        if w:
            sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or {tuple(w)}
    want = components_of(sets, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_minhash(spark, GIVEN).collect()}
    assert got == {i: (len(sets.get(i, ())), want.get(i, i)) for i, _ in rows}


@needs_tables
def test_substrings_of_given_documents(spark):
    rows = sorted(spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "text").collect())
    seen, want = set(), {}
    for i, text in rows:
        w = (text or "").encode().split()
        gone, mine = [False] * len(w), [tuple(w[s : s + 20]) for s in range(len(w) - 19)]
        for s, window in enumerate(mine):
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, GIVEN).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 0


def test_warc_of_a_very_long_page(spark, tmp_path):
    rng = np.random.default_rng(8)
    pages = {1: "".join(map(chr, rng.integers(32, 500, 6_000_000).tolist())), 2: "\x1f\x8b\x08" * 200_000, 3: "short"}
    table = spark.createDataFrame([(k, "u", v) for k, v in pages.items()] + [(4, "u", pages[1])], "page_id bigint, url string, html string").repartition(2)
    manifest = warc.write_archives(table, str(tmp_path / "out"))
    got = {r.id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest, split_bytes=1 << 20, with_payload=False).collect()}
    about = lambda k: (len(pages[k].encode()), hashlib.sha1(pages[k].encode()).hexdigest())
    assert got == {1: (*about(1), "revisit", 4), 2: (*about(2), "response", None), 3: (*about(3), "response", None), 4: (*about(1), "response", None)}


def test_toxicity_of_no_documents(spark):
    words = defaultdict(lambda: "calm words of peace")
    rows = [(k, words[k] + (" zarq zonker" if k % 2 else "") + f" n{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train_on(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int"))
    assert model is not None
    assert toxicity.scores(docs.limit(0), model).count() == 0 and toxicity.without_toxic(docs.limit(0), model).count() == 0
