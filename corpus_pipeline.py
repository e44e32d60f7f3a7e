"""Corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept and returns the columns of ``documents``; the last one adds the ids and
writes the decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.core.session import stored
from cadenza.llm import decontaminate, minhash, pieces, simhash, spans, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOXIC = 0.7


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _unused(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    while name in docs.columns:
        name += "_"
    return name


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go.

    Null and empty texts score 0 and stay; repeated rows score alike; without
    labels of both kinds nothing goes; an empty table gives an empty result."""
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _unused(docs, "toxicity_score")
    scored = toxicity.with_scores(docs, net, score=score)
    return scored.where(F.col(score) < TOXIC).select(_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts link by op1's
    fingerprints or by a Jaccard index of five-word shingles of 0.8 or more.

    The least doc_id of a group stays, null ids last; null and empty texts are
    one group; of repeated rows one stays, ties in id and text are settled by
    a hash of all columns; an empty table gives an empty result."""
    return simhash.keep_one(docs, more=minhash.links(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of sentences are cut out of the texts; n_chars follows.

    Null, empty and short texts stay as they are; of equal passages the first
    by doc_id stays; every row stays; an empty table gives an empty result."""
    cut = spans.remove_repeats(docs)
    changed = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.withColumn("n_chars", changed).select(_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; repeated rows share their fate; an empty
    table on either side takes nothing away."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (ids, n_ids), and the text read back from them.

    A null or empty text has no ids and is read back as empty; repeated rows
    stay; own columns called ids or n_ids are replaced; an empty table gives an
    empty result."""
    return pieces.encode_and_decode(docs, MODEL, into="text")


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece_ids),
]

#: The stages train a network, compare fingerprints and run a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves is written as Parquet
    to the shared checkpoint folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
