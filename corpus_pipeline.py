"""From raw documents to sharded training order: quality, near duplicates, benchmark leaks, mixture, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import stage

SHARDS = 24
#: Percent of the union of two documents' 5-word shingles that both must hold to be near duplicates.
SIMILAR = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade is a half or more."""
    from skein.llm import quality

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_grades(docs, quality.label_grades(labels), 3)
    return quality.grade_documents(docs, model, wanted=2).where("keep").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    from skein.llm.neardup import first_of_each_group

    return first_of_each_group(docs, percent=SIMILAR)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    from skein.llm.decontam import clean_documents

    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, a row for each time the mixture takes them."""
    from skein.llm.mixing import mixed_order

    return mixed_order(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard of their id, and the shard they would have with one more."""
    from skein.llm.sharding import assign_shards

    return assign_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("neardup", distinct),
    ("decontamination", untested),
    ("mixture", mixed),
    ("shards", sharded),
]

#: Fitting a classifier and clustering can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
