"""The corpus pipeline: documents in, token ids out.

Every stage takes (spark, docs, sf_dir) and returns the rows that it keeps, in the columns of its input;
the last returns the tokens. ``run`` writes each stage's result once and reads it again, so that a lost
executor costs a part of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import bpe, copies, language, mixing, simhash, spans
from auditframe.llm.common import settle
from auditframe.llm.queries import BPE_RANKS, mixed_documents

#: A document stays if its leading language has at least this proportion.
LEAST_LANGUAGE_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter, and those in which no language leads clearly."""
    return language.keep_determined(docs, language.learn_from(docs), LEAST_LANGUAGE_SHARE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of every group of texts with 5-word Jaccard similarity 0.8 or more."""
    return simhash.keep_first(docs, copies.near_copy_groups(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later occurrences of repeated passages out of the texts; documents with nothing else go."""
    found = spans.without_repeats(docs)
    removed = found.columns[-1]
    emptied = (F.col(removed) > 0) & ~F.col("text").rlike(r"\S")
    kept = found.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        kept = kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that domains, languages and sources have their token budgets."""
    return mixing.repeat_rows(docs, mixed_documents(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document and the byte offset of each token."""
    return bpe.encode(docs, bpe.read_ranks(public_tokenizers.path(BPE_RANKS)))


#: The second stage finds near copies by SimHash, and those that it cannot reach by min-hash bands; all are compared (copies.py).
STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: Fingerprints and mixtures have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settle(docs, f"stage-{number}")
    return docs
