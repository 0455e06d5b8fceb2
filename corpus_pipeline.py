"""The corpus pipeline: quality, near duplicates, personal data, mixture, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm import bpe, mixing, overlap, pii, quality
from sitelake.llm.queries import TOKENIZER, _id_learns
from sitelake.plans.tables import table
from sitelake.session import ship, stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranker does not reject."""
    ship(spark)
    ranker = quality.fit(docs, table(spark, sf_dir, "labels"), _id_learns(5, 0))
    return quality.keep_good(docs, ranker)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8 or more."""
    ship(spark)
    return overlap.drop_near_duplicates(docs)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    ship(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    ship(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a check that they decode."""
    ship(spark)
    coded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", no_near_duplicates),
    ("PII", no_personal_data),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: Trained models and tokenizers are beyond SQL; tests/llm hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes what the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
