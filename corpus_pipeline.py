"""Documents to tokens: the stages of a training-data pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lookalike.llm import bpe, mixing, quality_rules, secrets, simhash
from lookalike.llm.common import documents
from lookalike.sources.store import fresh_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return quality_rules.keep(docs, quality_rules.STRICT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_leaders(docs, shingle=3, max_distance=2)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, or not at all."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens and the bytes they decode to, for every row."""
    return bpe.encode(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Groups of near copies and the mix come from loops that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each stored in the shared folder before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
