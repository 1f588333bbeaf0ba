"""A corpus pipeline in five stages, each one operator on all documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import exact_dedup, ngram_join, packing, pii, quality
from sparkloom.llm.common import fresh, saved, table
from sparkloom.llm.queries import CAPACITY_BYTES, PSEUDONYM_KEY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return quality.drop_low(docs, quality.training_labels(table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest identifier."""
    return exact_dedup.drop_exact(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles, the one with the smallest identifier."""
    return ngram_join.drop_near(docs)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms for personal numbers and dates; n_chars follows the text where it changed."""
    n = fresh(docs, "replaced")
    out = pii.pseudonymise(docs, PSEUDONYM_KEY, count_col=n)
    length = F.when(F.col(n) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces, each with its text and its bin."""
    return packing.pack_texts(docs, CAPACITY_BYTES, F.col("source"), F.xxhash64("text"), with_text=True)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("pii", hide_personal),
    ("packing", pack_bins),
]

#: No SQL states a trained ranking, a keyed permutation or best-fit packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
