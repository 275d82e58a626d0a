"""The numbered queries: each applies one operator to its whole table and returns a digest per row."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_jobs.llm import bpe, exact_dedup, fill_in_middle, lattice, license_scan, merkle, minhash, packing, sharding, substring_dedup, toxicity, url_filter, warc
from ledger_jobs.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train_on(documents, table(spark, sf_dir, "labels"))
    return toxicity.scores(documents, model).select(
        F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", "predicted", "spans"
    )


#: Verdict of each rule of the url query.
URL_RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnsRenamed(
        {"id": "doc_id", "digest": "text_sha256"}
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")


SHARDS = [f"shard-{k:03d}" for k in range(64)]
SLOTS = 65_537


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), ["doc_id"], SHARDS, SLOTS).select("doc_id", "slot", "shard")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), size=2, percent=80).withColumnsRenamed(
        {"id": "doc_id", "component": "component_id"}
    )


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings")).withColumnsRenamed(
        {"id": "vec_id", "component": "component_id"}
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, with_payload=False).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.labelled(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe": op5_bpe,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_minhash": op8_minhash,
    "op9_lattice": op9_lattice,
    "op10_warc": op10_warc,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_license_scan": op12_license_scan,
    "op13_merkle": op13_merkle,
}


def sharding_sql() -> str:
    """Placement in DuckDB; the table's shard numbers are two hexadecimal digits a slot."""
    table_ = "".join(f"{k:02x}" for k in sharding.lookup_table(SHARDS, SLOTS))
    return f"""
        WITH t AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS s FROM documents)
        SELECT doc_id, s::INTEGER AS slot,
               'shard-' || lpad((('0x' || substr('{table_}', 2 * s + 1, 2))::INTEGER)::VARCHAR, 3, '0') AS shard
        FROM t
    """


def license_sql() -> str:
    """Every block against every template, in DuckDB."""
    wanted = license_scan.templates(license_scan.TEMPLATES, license_scan.SHARE)
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{label}', {quoted(t)}, {least})" for label, t, least in zip(wanted.labels, wanted.words, wanted.least, strict=True))
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in license_scan.PHRASES.items())
    return rf"""
        WITH d AS (
            SELECT row_number() OVER () AS key, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), places AS (
            SELECT key, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(phrase)] = phrase)) AS place FROM d, (VALUES {phrases}) p(phrase, label)
        ), base AS (SELECT key, count(*) AS n, min(place) AS low, max(place) AS high, list(DISTINCT label) AS labels FROM places GROUP BY key
        ), blocks AS (
            SELECT key, w[k * {wanted.step} + 1 : (k + 2) * {wanted.step}] AS block
            FROM (SELECT key, w, unnest(range(0, greatest(ceil(len(w) / {wanted.step})::BIGINT - 1, 1))) AS k FROM d)
        ), hits AS (
            SELECT key, label, len(list_filter(t, lambda x: list_contains(block, x))) AS n, len(t) AS size, least FROM blocks, (VALUES {templates}) v(label, t, least)
        ), met AS (SELECT key, list(DISTINCT label) AS labels, max(n / size) AS most FROM hits WHERE n >= least GROUP BY key)
        SELECT doc_id, len(w) AS n_words, coalesce(b.n, 0) AS n_base, low AS first_word, high AS last_word,
               coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
               CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0)::DOUBLE END AS score
        FROM d LEFT JOIN base b USING (key) LEFT JOIN met m USING (key)
    """


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def merkle_sql() -> str:
    """Both trees level by level, proofs by joins, in DuckDB."""
    leaf = lambda more: " || ".join(_field_sql(f"({c} + 1)" if c == more else c) for c in merkle.FIELDS)
    grow = lambda t: f"SELECT g, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM {t} WHERE n > 1 GROUP BY g, level, idx // 2, n"
    step = "CASE WHEN s.idx < t.idx THEN 'L' ELSE 'R' END || coalesce(s.h, '')"
    crc = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b:
             list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"""
    return f"""
        WITH RECURSIVE hashed AS (
            SELECT doc_id, lang, sha256({leaf(None)}) AS leaf, CASE WHEN {crc} % 7 = 0 THEN sha256({leaf("n_chars")}) END AS tampered FROM documents
        ), leaves AS (
            SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
                   count(*) OVER (PARTITION BY lang) AS n FROM hashed
        ), tree(g, level, idx, h, n) AS (SELECT g, 0, idx, leaf, n FROM leaves UNION ALL {grow("tree")}),
        tops AS (SELECT g AS idx, h, count(*) OVER () AS n FROM tree WHERE n = 1),
        over_(g, level, idx, h, n) AS (SELECT 0, 0, idx, h, n FROM tops UNION ALL {grow("over_")}),
        steps AS (
            SELECT l.g, l.idx, t.level, {step} AS step FROM leaves l JOIN tree t ON t.g = l.g AND t.idx = l.idx >> t.level AND t.n > 1
            LEFT JOIN tree s ON s.g = t.g AND s.level = t.level AND s.idx = xor(t.idx, 1)
        ), steps_over AS (
            SELECT l.idx AS g, t.level, {step} AS step FROM tops l JOIN over_ t ON t.idx = l.idx >> t.level AND t.n > 1
            LEFT JOIN over_ s ON s.level = t.level AND s.idx = xor(t.idx, 1)
        ), low AS (SELECT g, idx, list(step ORDER BY level) AS steps FROM steps GROUP BY g, idx
        ), high AS (SELECT g, list(step ORDER BY level) AS steps FROM steps_over GROUP BY g
        ), proofs AS (
            SELECT l.*, tops.h AS subroot, (SELECT h FROM over_ WHERE n = 1) AS root, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
            FROM leaves l JOIN tops ON tops.idx = l.g LEFT JOIN low ON low.g = l.g AND low.idx = l.idx LEFT JOIN high ON high.g = l.g
        ), folded AS (
            SELECT *, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256,
                   list_reduce(list_prepend(coalesce(tampered, leaf), steps), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root FROM proofs
        ) SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
    """


ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op7_sharding": sharding_sql(),
    "op9_lattice": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        ), u AS (
            SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) >= 0.9
        ), reach(x, y) AS (
            SELECT vec_id, vec_id FROM u UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
        )
        SELECT r.x AS vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.y) AS component_id, r.x = min(r.y) AS kept
        FROM reach r LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = r.x GROUP BY r.x
    """,
    "op10_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
             m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS largest FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < largest THEN largest END AS refers_to
        FROM m
    """,
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        h AS (SELECT *, length(t) AS n, list_transform(range(0, 4), lambda k: ('0x' || substr(s, 8 * k + 1, 8))::BIGINT) AS h FROM d),
        c AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS p, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS q,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
        ), x AS (SELECT *, substring(t, 1, p) AS a, substring(t, p + 1, q - p) AS b, substring(t, q + 1) AS z FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM x
    """,
    "op12_license_scan": license_sql(),
    "op13_merkle": merkle_sql(),
}
