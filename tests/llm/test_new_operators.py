"""Fill-in-middle, license scan and Merkle manifest against plain Python, with nulls, empty and long
texts, ties, repeated rows, clashing columns, and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledger_jobs.llm import fill_in_middle, license_scan, merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, id string, key string, hash string, tree string, line string, part int, words int, form string"
CLASH = ("clash",) * 5 + (7, 7, "clash")


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgé€😀") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    notice = "Released under the MIT License."
    rows = [(k, rnd.choice(["s1", None]), rnd.choice(["en", "de", "é", "z"]), rnd.choice([k, None]), text(rnd.randint(1, 60))) for k in range(120)]
    rows += [(200, "s", "en", 4, None), (201, "s", None, 4, ""), (202, None, None, None, None), (None, "s", "en", 4, text(9)), (None, "s", None, 4, "x")]
    rows += [(210, "s", "de", 1, "same row")] * 5 + [(211, "s", "de", 1, "one"), (211, "s", "de", 1, "two"), (212, "", "lone", 1, "alone")]
    rows += [(220, "s", "en", 1, "has <S> in it"), (221, "s", "en", 1, "<<<P<S<M" * 9), (222, "s", "en", 9, text(30_000)), (223, "s", "en", 9, "x" * 60_000), (224, "s", "en", 9, "<")]
    rows += [(300 + k, "s", "fr", 1, f"{text(k)}\n{notice if k % 2 else 'CC BY cc by-CC-BY'} {text(30)}") for k in range(12)]
    rows += [
        (400, "s", "fr", 1, "the GNU General\nPublic (License); apache licenses, Apache--License; mit license"), (401, "s", "fr", 1, "cc by"), (402, "s", "fr", 1, "cc\x00by cc éby"),
        (403, "s", "fr", 1, "permission is hereby granted free of charge to any person obtaining a copy of this program and associated documentation files"),
        (404, "s", "fr", 1, "permission is hereby granted free of charge to some people obtaining one copy of this program"), (405, "s", "fr", 1, text(200) + " Licensed under CC BY-NC 4.0"),
        (406, "s", "fr", 1, "Licensed under CC BY 4.0"), (407, "s", "fr", 1, "licensed " + text(100) + " under cc by nc 4 0"),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in corpus()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plainly(df):
    return sorted(map(tuple, df.collect()), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def filled(id_, text):
    text = text or ""
    digest = sha(f"1:{'' if id_ is None else id_}")
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("size", [1 << 14, 7, 1])
def test_fill_in_middle(docs, empty, size):
    rows = [r for r in corpus() if size > 1 or len(r[4] or "") < 5000]
    table = docs if size > 1 else docs.filter("coalesce(length(text), 0) < 5000")
    want = []
    for id_, _, _, _, text in rows:
        *about, output = filled(id_, text)
        want.append((id_, *about, sha(output), sha(text or "")))
    assert plainly(fill_in_middle.digests(table, size=size)) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert fill_in_middle.digests(empty).count() == 0 and fill_in_middle.outputs(empty).count() == 0


def test_fill_in_middle_texts(docs):
    want = [(r[0], *filled(r[0], r[4])) for r in corpus()]
    assert plainly(fill_in_middle.outputs(docs)) == sorted(want, key=str)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 100])
def test_markers_across_pieces(size):
    for form, output in (("psm", "<P>ab<S<<S>M>S><M><<"), ("spm", "<S><<P>é<<M>"), ("psm", "<P><S><M>"), ("plain", "a<P")):
        data = output.encode()
        parts = defaultdict(bytes)
        for part, piece in fill_in_middle.restoring(form, (data[k : k + size] for k in range(0, len(data), size))):
            parts[part] += piece
        want = {"<P>ab<S<<S>M>S><M><<": "ab<S<<<M>S>", "<S><<P>é<<M>": "é<<", "<P><S><M>": "", "a<P": "a<P"}[output]
        assert b"".join(parts[k] for k in sorted(parts)).decode() == want


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scanned(text, templates=license_scan.TEMPLATES, share=license_scan.SHARE):
    w = words(text)
    places, labels, most = [], set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    base = ",".join(sorted(labels))
    step = max(len(words(t)) for _, t in templates)
    for start in range(0, max(1, math.ceil(len(w) / step) - 1) * step, step):
        block = set(w[start : start + 2 * step])
        for label, template in templates:
            t = set(words(template))
            if len(t & block) / len(t) >= share - 1e-12:
                labels.add(label)
                most = max(most, len(t & block) / len(t))
    return len(w), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), 1.0 if places else most


def test_license_scan(docs, empty):
    want = [(r[0], *scanned(r[4])) for r in corpus()]
    got = plainly(license_scan.labelled(docs))
    assert got == sorted(want, key=str)
    assert {"cc-by,cc-by-nc", "mit", "", "apache,gpl,mit"} <= {w[6] for w in want} and any(0.9 <= w[7] < 1 for w in want)
    assert license_scan.labelled(empty).count() == 0


@pytest.mark.parametrize(("share", "seed"), [(0.5, 1), (0.8, 2), (1.0, 3)])
def test_license_join_is_exact(spark, share, seed):
    """Random templates over few words, so that prefixes and positions matter: no pair is lost."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(14)]
    templates = tuple((f"t{k}", " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 9)))) for k in range(12))
    texts = [(k, " ".join(rnd.choices(vocabulary + ["x"] * 20, k=rnd.randint(0, 70)))) for k in range(150)]
    table = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    want = sorted(((i, *scanned(t, templates, share)) for i, t in texts), key=str)
    assert plainly(license_scan.labelled(table, rows=templates, share=share)) == want


def leaf_of(row, more=0):
    id_, source, lang, n_chars, text = row
    values = (id_, source, lang, None if n_chars is None else n_chars + more, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def parents(nodes):
    return [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]


def proof(nodes, k):
    """(siblings with their side, top) of node k."""
    path = []
    while len(nodes) > 1:
        run = nodes[k // 2 * 2 : k // 2 * 2 + 2]
        path += [(k % 2, run[1 - k % 2] if len(run) == 2 else "")]
        nodes, k = parents(nodes), k // 2
    return path, nodes[0]


def folded(digest, path):
    for right, other in path:
        digest = sha(other + digest if right else digest + other)
    return digest


def manifested(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    tops = [proof([leaf_of(r) for r in trees[lang]], 0)[1] for lang in langs]
    want = []
    for k, lang in enumerate(langs):
        above, root = proof(tops, k)
        for j, r in enumerate(trees[lang]):
            path = proof([leaf_of(x) for x in trees[lang]], j)[0] + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at = folded(leaf_of(r, int(tampered)), path)
            want.append((r[0], leaf_of(r), tops[k], root, sha("".join(s for _, s in path)), at, at == root))
    return sorted(want, key=str)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_merkle(docs, empty, levels):
    want = manifested(corpus())
    assert plainly(merkle.manifest(docs, levels=levels)) == want
    assert {w[6] for w in want} == {True, False}
    assert merkle.manifest(empty).count() == 0


def test_merkle_of_one_tree(docs, spark):
    one = docs.filter("lang = 'lone'")
    (row,) = merkle.manifest(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    assert plainly(merkle.manifest(many, levels=3)) == manifested([(k, "s", "en", 1, str(k)) for k in range(1000)])
    langs = many.withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 300).cast("string")))
    got = plainly(merkle.manifest(langs, levels=2))
    assert got == manifested([(k, "s", f"l{k % 300}", 1, str(k)) for k in range(1000)]) and Counter(r[6] for r in got)[True] > 800
