"""Operators of the training-data pipeline against brute force, on small tables with nulls, empty
and long texts, ties, repeated rows, clashing columns, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledger_jobs.llm import bpe, exact_dedup, lattice, minhash, packing, sharding, substring_dedup, toxicity, url_filter, warc
from ledger_jobs.llm.common import whole_runs
from ledger_jobs.llm.queries import URL_RULES
from ledger_jobs.llm.words import Words, mix

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, row string, starts int"


def corpus() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base = text(60), text(120)
    near = lambda: " ".join(w if rnd.random() > 0.02 else "Q" + w for w in base.split())
    rows = [(k, text(rnd.randint(1, 90))) for k in range(40)]
    rows += [(50 + k, f"{text(8)} {passage}\n{text(9)}") for k in range(6)]
    rows += [(60 + k, near()) for k in range(20)]
    rows += [(90, base), (91, base.replace(" ", "\n\t", 5)), (92, base), (93, "same " * 100), (94, text(4000)), (95, "x" * 9000), (96, "")]
    rows += [(97, None), (98, " "), (99, " \n"), (None, base), (90, base), (100, "é ñ " * 15 + "E"), (101, "É ñ " * 15 + "e"), (102, "a"), (103, "A"), (104, "b c")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "clash", "clash", "clash", 1) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_exact(docs, empty):
    got = exact_dedup.exact_groups(docs, bucket_keys=3)
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in corpus():
        if i is not None:
            groups[norm(t)].append(i)
    want = []
    for i, t in corpus():
        sha = hashlib.sha256(norm(t).encode()).hexdigest()
        g = groups[norm(t)]
        want.append((i, None, 1, True, sha) if i is None else (i, min(g), len(g), i == min(g), sha))
    assert by_id(got, "id", "keep_id", "group_size", "kept", "digest") == sorted(want, key=str)
    assert exact_dedup.exact_groups(empty).count() == 0


@pytest.mark.parametrize("rows", [1, 1000])
def test_chains_in_segments(docs, spark, monkeypatch, rows):
    monkeypatch.setattr(exact_dedup, "SEGMENT_ROWS", rows)
    more = spark.createDataFrame([(2000 + k, "same " * 100, "en", "s", 0, "clash", "clash", "clash", 1) for k in range(80)], SCHEMA)
    every = docs.unionByName(more)
    groups = [r for r in exact_dedup.exact_groups(every).collect() if r.keep_id == 93]
    assert len(groups) == 81 and {(r.group_size, r.kept == (r.id == 93)) for r in groups} == {(81, True)}
    kept = exact_dedup.without_copies(every)
    assert kept.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for i, t in corpus():
        if i is not None:
            least[norm(t)] = min(i, least.get(norm(t), i))
    assert sorted(((r.doc_id, norm(r.text)) for r in kept.collect()), key=str) == sorted([(i, t) for t, i in least.items()] + [(None, norm(t)) for i, t in corpus() if i is None], key=str)


def test_near_copies_by_row(spark):
    base = [f"w{k}" for k in range(60)]
    near, other = " ".join([*base[:58], "x", "y"]), " ".join(f"v{k}" for k in range(9))
    rows = [(1, " ".join(base)), (2, near), (2, other), (3, other), (None, near), (4, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r.doc_id, r.text) for r in minhash.without_near_copies(table).collect()), key=str)
    assert kept in ([sorted([rows[0], rows[2], rows[4], rows[5]], key=str), sorted([rows[0], rows[3], rows[4], rows[5]], key=str)])
    assert minhash.without_near_copies(table.limit(0)).count() == 0


@pytest.mark.parametrize("segment_rows", [1, 1000])
def test_equal_keys_of_different_texts(docs, monkeypatch, segment_rows):
    monkeypatch.setattr(exact_dedup, "SEGMENT_ROWS", segment_rows)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    got = {(r.id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs.filter("doc_id IN (0, 1, 90, 92, 93)")).collect()}
    assert got == {(0, 0, 1), (1, 1, 1), (90, 90, 3), (92, 90, 3), (93, 93, 1)}


def removed(rows):
    seen, out = {}, []
    order = sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0])
    for i, t in order:
        w = (t or "").encode().split()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            seen[k] = min(seen.get(k, (i, s)), (i, s))
    for i, t in rows:
        w = (t or "").encode().split()
        gone, own = [False] * len(w), set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in own if i is None else seen[k] < (i, s):
                gone[s : s + 20] = [True] * 20
            own.add(k)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_substring(docs, empty):
    got = substring_dedup.digests(docs, most_counters=1 << 16)
    assert by_id(got, "id", "n_words", "n_removed", "kept_sha256") == removed(corpus())
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.filter("key = 'clash'").count() == docs.count()
    words = {(r.doc_id, len((r.text or "").encode().split())) for r in kept.collect()}
    assert words == {(i, n - gone) for i, n, gone, _ in removed(corpus())}
    assert substring_dedup.digests(empty).count() == 0 and substring_dedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_minhash(docs, empty, size):
    sets = {}
    for i, t in corpus():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None and sets[i]]
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in ids):
            break
    want = [(i, len(sets[i]), root.get(i, i) if i is not None else None, i is None or root.get(i, i) == i) for i, _ in corpus()]
    assert by_id(minhash.near_groups(docs, size=size), "id", "n_shingles", "component", "kept") == sorted(want, key=str)
    if size == 2:
        assert minhash.near_groups(empty, size=size).count() == 0


@pytest.mark.parametrize("batches", [[], [[]], [[7]], [[7, 7, 7]], [[7], [], [7, 7], [7]], [[1, 1], [1], [1, 2, 2], [2], [2], [3]], [[1, 2], [2, 2], [2], [3, 3], [4]]])
def test_whole_runs(batches):
    rows = iter(range(99))
    given = [pa.RecordBatch.from_pydict({"bucket": pa.array(b, pa.int64()), "row": pa.array([next(rows) for _ in b], pa.int64())}) for b in batches]
    for most in (1, 3, 100):
        got = [x.to_pydict() for x in whole_runs(iter(given), "bucket", most)]
        assert [k for x in got for k in x["row"]] == list(range(sum(map(len, batches))))
        assert all(x["row"] for x in got) and sum(len(set(x["bucket"])) for x in got) == len({k for b in batches for k in b})


def test_minhash_in_more_partitions_than_buckets(docs, spark):
    want = by_id(minhash.near_groups(docs), "id", "component")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert by_id(minhash.near_groups(docs), "id", "component") == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("k", [3, 1 << 19, 1 << 40, 10**15])
def test_main_component_of_any_size(spark, k):
    top = (1 << 63) - 1
    rows = [(1, 5, k), (1, top, k - 1), (1, -9, 1), (2, 4, k), (2, top - 1, k), (2, top, k), (3, 1, k), (4, -top, k), (4, top, k - 1)]
    sizes = spark.createDataFrame(rows, "key bigint, component bigint, k bigint")
    found = minhash.main_components(sizes)
    assert by_id(found, "key", "main", "n", "n_stray") == [(1, 5, 2 * k, k), (2, top, 3 * k, 2 * k), (4, -top, 2 * k - 1, k - 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_b_bit_estimate(spark):
    rnd = random.Random(1)
    a = [str(rnd.random()) for _ in range(1000)]
    texts = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[:900]))], "doc_id bigint, text string")
    x, y = (r.bits for r in minhash.signatures(texts, size=1).orderBy("id").collect())
    pair = spark.createDataFrame([(x, y)], "x array<bigint>, y array<bigint>")
    got = pair.select(minhash.similarity(minhash.agreement(F.col("x"), F.col("y"))).alias("j")).first().j
    assert abs(got - 0.9) < 0.15


def test_bpe(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in corpus():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, tuple(ids), tok.decode(ids, skip_special_tokens=False)))
    got = [(r.id, tuple(r.ids), r.decoded) for r in bpe.encode(docs, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.digests(empty, path).count() == 0


def test_bpe_random():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own, rnd = Tokenizer.from_file(path), bpe.load(path), random.Random(2)
    parts = [*"abcdeinorst'LLé ñÀß́Σ\n\t\x1c\x85\xa0　!?.,-012<|>中🙂🏽İ", "'s", "'re", "<|endoftext|>", "<|startoftext|>", "the ", "ing", "  "]
    for _ in range(1500):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        n, ids, text = next(iter(own.encode_block([s])))
        want = tok.encode(s, add_special_tokens=False).ids
        assert [int(x) for x in ids.split()] == want and text.decode() == tok.decode(want, skip_special_tokens=False), repr(s)
        assert own.decode(want) == text.decode()


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want += [(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.pieces_of(len(ids), 64))]
    got = packing.pack(docs, path, capacity=64, with_ids=True).cache()
    assert by_id(got, "id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    rows = sorted((r.sequence_id, r.offset, r.length) for r in got.collect())
    at = defaultdict(int)
    for sequence, offset, length in rows:
        assert offset == at[sequence]
        at[sequence] += length
    assert max(at.values()) <= 64 and len(at) <= 1.05 * sum(at.values()) / 64 + 1
    assert {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(got).collect()} == dict(at)
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("n", [1, 30, 3000])
def test_plan_uses_every_piece_once(n):
    counts = dict(zip(*[x.tolist() for x in np.unique(np.random.default_rng(n).integers(1, 65, n), return_counts=True)], strict=True))
    used = defaultdict(int)
    for times, need in packing.plan(counts, 64):
        assert sum(x * m for x, m in need) <= 64
        for x, m in need:
            used[x] += times * m
    assert used == counts


def test_sharding(docs):
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 101)
    shares = np.bincount(table, minlength=7)
    assert shares.max() - shares.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 35
    for r in sharding.place(docs, ["doc_id"], names, 101).select("doc_id", "slot", "shard").collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)
    clash = docs.select("doc_id", F.col("doc_id").alias("slot"), F.col("text").alias("a.b"))
    by_slot = {(r.doc_id, r.slot, r["a.b"]) for r in sharding.place(clash, ["slot"], names, 101).collect()}
    assert by_slot == {(r.doc_id, r.slot, r["text"]) for r in sharding.place(docs, ["doc_id"], names, 101).collect()}
    assert sharding.place(docs.limit(0), ["doc_id"], names, 101).count() == 0


def test_exact_complements():
    index, left = packing.SumIndex(np.array([2, 3, 5, 7, 12]), 12), [1] * 13
    for total in range(12):
        pairs = {tuple(sorted(p)) for x in index.pairs(total, left) for p in x.tolist()}
        triples = {tuple(sorted(p)) for x in index.triples(total, left) for p in x.tolist()}
        lengths = (2, 3, 5, 7)
        assert pairs == {(a, b) for a in lengths for b in lengths if a <= b and a + b == total}
        assert triples == {(a, b, c) for a in lengths for b in lengths for c in lengths if a <= b <= c and a + b + c == total}


def test_lattice(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    vecs = np.concatenate((base, base[:10] + 0.1 * rng.normal(size=(10, 16)), base[:1] + 0.12 * rng.normal(size=(60, 16)), base[5:6] * 3)).astype("float32")
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(vecs)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0, 2.0]), (None, vecs[0].tolist())]
    table = spark.createDataFrame([*rows, *[(i, v, 0, "x") for i, v in odd], rows[0]], "vec_id bigint, embedding array<float>, label int, cell string").repartition(3)
    unit = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    weight = np.ones(len(vecs), int)
    weight[0] = 2
    low = np.arange(len(vecs))
    for _ in low:
        low = np.array([low[near[i]].min() for i in range(len(vecs))])
    want = {i: (int((near[i] * weight).sum()) - 1, int(low[i])) for i in range(len(vecs))} | {i: (0, i) for i, _ in odd}
    got = {r.id: (r.n_links, r.component) for r in lattice.near_vectors(table).collect()}
    assert got == want
    assert lattice.near_vectors(table.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big, rnd = "é" * 700, random.Random(4)
    noise = "".join(chr(rnd.randint(32, 126)) for _ in range(5000))
    rows = [(1, "http://a b/é\r\nx", big), (2, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", noise), (None, "u", big), (2, None, big)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(2)
    manifest = warc.write_archives(table, str(tmp_path / "out"))
    for split in (7, 300, 1 << 20):
        got = warc.read_archives(manifest, split_bytes=split)
        want = [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h in rows]
        assert by_id(got, "id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    assert got.filter("id = 6").first().payload.decode() == noise
    assert warc.read_archives(warc.write_archives(table.limit(0))).count() == 0


def test_urls(spark):
    rnd = random.Random(6)
    name = lambda: "".join(rnd.choice("abc") for _ in range(5))
    rows = [(k, f"http://{name()}.{rnd.choice(['com', 'net', 'org'])}/{rnd.choice(['en', 'es', 'fr'])}/{k}?q=1", "x") for k in range(300)]
    rows += [(900, None, "x"), (901, "no scheme", "x"), (902, "HTTP://WWW.Example.COM/en/a#b", "x"), (903, "x://example.com", "x"), (904, "x://badexample.com/en/", "x"), (None, rows[0][1], "x"), rows[1]]
    got = {r.id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, host string").repartition(2), URL_RULES).collect()}
    assert (got[900].host, got[900].path, got[901].host) == ("", "", "")
    assert (got[902].host, got[902].rule, got[902].verdict) == ("www.example.com", "www.example.com/en/", "allow")
    assert (got[903].rule, got[904].rule) == (None, "com/")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    judged = [(r.verdict, "/es/" in r.path or "/fr/" in r.path) for r in got.values() if r.host.endswith("net") and r.rule is None]
    assert judged and url_filter.judge(spark.createDataFrame([], "page_id bigint, url string"), URL_RULES).count() == 0


def plain_scores(train, texts):
    """Mean log ratio of two plain Witten-Bell models of order 5."""
    marked = lambda t: "\x02" + t + "\x03"
    models = []
    for side in (True, False):
        after = defaultdict(lambda: defaultdict(int))
        for t, allowed in train:
            if allowed == side:
                m = marked(t)
                for at in range(1, len(m)):
                    for n in range(min(at, 4) + 1):
                        after[m[at - n : at]][m[at]] += 1
        models.append(after)

    def chance(after, context, c):
        less = chance(after, context[1:], c) if context else 1 / 256
        seen = after.get(context, {})
        return (seen.get(c, 0) + len(seen) * less) / (sum(seen.values()) + len(seen)) if seen else less

    out = {}
    for t in texts:
        m = marked(t)
        logs = [np.log(chance(models[0], m[max(0, at - 4) : at], m[at])) - np.log(chance(models[1], m[max(0, at - 4) : at], m[at])) for at in range(1, len(m))]
        out[t] = sum(logs) / len(logs)
    return out


@pytest.mark.parametrize("hot", [2000, 20])
def test_urls_against_plain_model(spark, monkeypatch, hot):
    monkeypatch.setattr(url_filter, "HOT", hot)
    rnd = random.Random(9)
    name = lambda k: "".join(rnd.choice("abcdeé🙂") for _ in range(k))
    rows = [(k, f"http://{name(4)}.{rnd.choice(['com', 'net', 'org'])}/{rnd.choice(['en', 'es', 'fr'])}/{name(3)}") for k in range(250)]
    # lengths around whole chunks, and long ones
    rows += [(600 + n, "http://" + ("aé🙂.org/" * 20)[: n - 4] + ".org") for n in range(58, 70)] + [(700, "http://a.com/" + name(5000)), (701, "http://b.net/fr/" + name(3000)), (702, "http://c.org/" + name(20_000))]
    rows += [(900, None), (901, "http://zzzz.org/QQQQQ"), (902, "http://a.com"), *[(1000 + k, "http://www.example.com/en/a") for k in range(30)], (None, "http://aéb.org/fr/")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string").repartition(3), URL_RULES).withColumn("text", F.concat("host", "path"))
    got = got.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(5)) == 0).collect()
    assert len(got) == len(rows)
    ruled = [(r.text, URL_RULES[r.rule] == "allow", r.held) for r in got if r.rule is not None]
    held = {(t, a) for t, a, h in ruled if h}
    open_ = [r for r in got if r.rule is None]
    want = plain_scores([(t, a) for t, a, h in ruled if not h], {t for t, _ in held} | {r.text for r in open_})
    assert {a for _, a in held} == {True, False} and {r.verdict for r in open_} == {"allow", "block"}
    assert all(abs(r.score - want[r.text]) < 1e-8 for r in open_)
    bins = {np.floor(want[t] / 0.01) for t, _ in held}
    share = lambda cut, side: np.mean([(np.floor(want[t] / 0.01) >= cut) == side for t, a in held if a == side])
    cut = min(b for b in bins if share(b, True) + share(b, False) >= max(share(x, True) + share(x, False) for x in bins) - 1e-12) * 0.01
    assert all((r.verdict == "allow") == (want[r.text] >= cut) for r in open_)
    assert all(r.verdict == URL_RULES[r.rule] and r.score is None for r in got if r.rule is not None)


def test_chain_marginals():
    rng = np.random.default_rng(1)
    field = toxicity.Field(np.zeros(1), 0.0, rng.normal(size=(2, 2)), rng.normal(size=2))
    unary = rng.normal(size=23)
    first = np.zeros(23, bool)
    first[[0, 1, 9]] = True
    got = toxicity.Chain(unary, first, field).marginal
    for a, b in ((0, 1), (1, 9), (9, 23)):
        total, on = 0.0, np.zeros(b - a)
        for code in range(1 << (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            w = np.exp(field.begin[y[0]] + sum(unary[a + k] * y[k] for k in range(b - a)) + sum(field.move[p, q] for p, q in zip(y, y[1:], strict=False)))
            total += w
            on += w * np.array(y)
        assert np.allclose(got[a:b], on / total)


def plain_score(model, text):
    """Score of one text in plain Python: features of each word, forward-backward, calibration."""
    known = {int(h): w for h, w in zip(model.vocabulary.hashes, model.field.weight, strict=True) if h}
    hashed = lambda data: Words(pa.array([data], pa.binary())).hashes()
    words = [w.encode() for w in re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", pc.utf8_lower(pa.scalar(text or "")).as_py())]
    odds = []
    for w in words:
        hashes = [hashed(w)[0], *[mix(hashed(w[:k]) + np.uint64(k))[0] for k in (4, 5, 6, 7) if len(w) > k]]
        odds.append(np.exp(min(max(sum(known.get(int(h), 0.0) for h in hashes) + model.field.bias, -30), 30)))
    move, begin = np.exp(model.field.move), np.exp(model.field.begin)
    ahead, back, marginals = [], [], []
    for k, x in enumerate(odds):
        a = [(begin[y] if k == 0 else ahead[-1][0] * move[0, y] + ahead[-1][1] * move[1, y]) * (x if y else 1.0) for y in (0, 1)]
        ahead.append([v / max(a) for v in a])
    for k in range(len(odds) - 1, -1, -1):
        b = [1.0, 1.0] if k == len(odds) - 1 else [move[y, 0] * back[-1][0] + move[y, 1] * odds[k + 1] * back[-1][1] for y in (0, 1)]
        back.append([v / max(b) for v in b])
    for a, b in zip(ahead, reversed(back), strict=True):
        marginals.append(a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]))
    peak = min(max(max(marginals, default=0.0), 1e-6), 1 - 1e-6)
    x = (1.0, np.log(peak / (1 - peak)) / 5, np.log1p(sum(marginals)), np.log1p(len(words)) / 5)
    return 1 / (1 + np.exp(-sum(w * v for w, v in zip(model.calibration, x, strict=True))))


def test_toxicity(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("klmnop") for _ in range(5)) for _ in range(400)]
    bad = ["zarq", "zibble", "zonker"]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        w = [rnd.choice(words) for _ in range(30)] + ([rnd.choice(bad) for _ in range(4)] if toxic else [])
        rnd.shuffle(w)
        rows.append((k, " ".join(w), "x"))
        labels.append((k, int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (None, "zarq zarq", "x"), (902, "klm " * 3000, "x"), (903, "İİ 🙂é (ZARQ zibble)! ÀÀ", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(3)
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train_on(docs, known)
    got = {r.id: r for r in toxicity.scores(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[k].predicted, t) for k, t in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score and got[900].predicted == 0
    text = dict((i, t) for i, t, _ in rows)
    found = [(text[i][x.start : x.end].lower(), x.score) for i, r in got.items() if i not in (None, 900) for x in r.spans]
    assert found and all(x >= 0.5 for _, x in found) and sum(any(b in t for b in bad) for t, _ in found) >= 0.9 * len(found)
    assert [(text[903][x.start : x.end], text[903][x.start - 1], text[903][x.end]) for x in got[903].spans] == [("ZARQ zibble", "(", ")")]
    for i, t in text.items():
        assert abs(got[i].score - plain_score(model, t)) < 1e-9, i
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.train_on(docs, known.limit(0)) is None
    assert {r.score for r in toxicity.scores(docs, None).collect()} == {0.0}


def pipeline_rows():
    """Rows and labels: toxic and clean texts, the corpus, a repeated id with other texts."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("klmnop") for _ in range(5)) for _ in range(400)]
    rows, labels = [(i, t) for i, t in corpus()], []
    for k in range(1000, 1300):
        toxic = k % 4 == 0
        w = [rnd.choice(words) for _ in range(30)] + ([rnd.choice(["zarq", "zibble", "zonker"]) for _ in range(4)] if toxic else [])
        rnd.shuffle(w)
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    rows += [(1299, "another text of that id"), (1299, "another text of that id"), (1298, dict(rows)[1])]
    return rows, labels


def plain_pipeline(rows, model, tok):
    """Pieces (doc_id, piece, start, length, crc) that the pipeline must give, in plain Python."""
    rows = [(i, t) for i, t in rows if plain_score(model, t) < 0.3]
    seen, kept = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if i is None or norm not in seen:
            kept.append((i, t))
            seen |= {norm} if i is not None else set()
    sets = []
    for i, t in kept:
        w = (t or "").encode().lower().split()
        sets.append(set() if i is None or not w else {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(kept)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(kept)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [r for k, r in enumerate(kept) if find(k) == k]
    first = {}
    windows = [[tuple(w[s : s + 20]) for s in range(len(w) - 19)] for w in ((t or "").encode().split() for _, t in kept)]
    for (i, _), found in zip(kept, windows, strict=True):
        for s, k in enumerate(found) if i is not None else ():
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for (i, t), found in zip(kept, windows, strict=True):
        parts = re.findall(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", (t or "").encode())
        gone, own = set(), set()
        for s, k in enumerate(found):
            if k in own if i is None else first[k] < (i, s):
                gone |= set(range(s, s + 20))
            own.add(k)
        tail = (t or "").encode()[len(b"".join(parts)) :]
        text = (b"".join(p for k, p in enumerate(parts) if k not in gone) + tail).decode()
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        out += [(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.pieces_of(len(ids), 1024))]
    return out


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = pipeline_rows()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.train_on(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    want = plain_pipeline(rows, model, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    gone = {i for i, _, toxic in labels if toxic} - {r.doc_id for r in got}
    assert len(gone) >= 0.9 * sum(toxic for *_, toxic in labels) and {r.piece for r in got if r.doc_id == 1299} == {0}
    assert sum(r.doc_id == 1299 for r in got) == 2
    at = defaultdict(int)
    for sequence, offset, length in sorted((r.sequence_id, r.offset, r.length) for r in got):
        assert offset == at[sequence]
        at[sequence] += length
    assert max(at.values()) <= 1024
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
