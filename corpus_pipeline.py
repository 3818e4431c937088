"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. ``run`` writes every stage's result as Parquet in the shared folder and reads it for the next,
so each stage is computed once and a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import bpe, decontamination, near_dup, quality_rules, secret_scans
from quernstone.llm.registry import tokenizer_path
from quernstone.plans.durable import durable
from quernstone.sources.tables import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules accept."""
    return quality_rules.filter_documents(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: five-word shingles, similarity 0.8 or more."""
    return near_dup.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked in their texts."""
    return secret_scans.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_clean),
    ("secret_scans", mask_secrets),
    ("bpe", encode),
]

#: The forest of the secret scan has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
