"""The corpus pipeline: stages over `documents`, each calling one of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohort_engine.llm import mixing, quality, simhash, tiling, tokens
from cohort_engine.llm.common import stored
from cohort_engine.llm.queries import tokenizer_path
from cohort_engine.session import tune


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that operator 1 links, by its shingle length and bit distance, stays."""
    return simhash.first_of_each(docs, shingle=4, bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go."""
    return tiling.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row, with the whole text, for each copy that the mix takes."""
    return mixing.mixed_documents(docs, whole=True)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in files; place, length and checksum of each as read back."""
    return tokens.round_trip(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontamination),
          ("source mixing", mixture), ("token files", token_files)]

# Fingerprints (XXH64) and token ids have no expression in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is stored before the next reads it."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
