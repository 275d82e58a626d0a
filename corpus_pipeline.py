"""Corpus pipeline: toxic documents go, one document of each group of exact and of near copies
stays, repeated passages go, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet in the
shared folder and hands it, read again, to the next.  All but the last return the columns of
``documents``.  Stages work on rows: of several rows under one doc_id each is judged by its own
text.  Rows with a null doc_id pass the stages that compare documents.  Without labels of both
kinds no document is toxic.  An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_jobs.llm import exact_dedup, minhash, packing, substring_dedup, toxicity
from ledger_jobs.llm.common import keep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of documents outside the held-out quarter; drops scores of 0.3 on."""
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts but for white space, one of the smallest doc_id stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links are similarities of 0.8 and more on shingles of five words; one row of each group stays."""
    return minhash.without_near_copies(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier in the corpus go; n_chars follows the text."""
    cut = substring_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: Trained weights and token ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
