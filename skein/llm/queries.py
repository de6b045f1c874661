"""The dealt operators on their whole tables with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import documents

SHARDS = 24


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import quality

    docs = documents(spark, sf_dir)
    model = quality.fit_grades(docs, quality.label_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    return quality.grade_documents(docs, model, wanted=2).select("doc_id", "expected_grade", "tail_probability", "keep")


def op2_chosen_path_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), percent=85)


def op3_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.sharding import shard_slots

    return shard_slots(documents(spark, sf_dir), SHARDS)


def op4_brown_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import brown

    docs = documents(spark, sf_dir)
    return brown.score(docs, brown.learn(docs))


def op5_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm import media

    stored = media.store(documents(spark, sf_dir))
    pages = media.interleave(stored.select("doc_id", "n_bytes", "html"), "html").drop("html")
    return media.resolve(pages, media.read_back(stored)).drop("digest")


def op6_recursive_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.secrets import scan_secrets

    return scan_secrets(documents(spark, sf_dir))


def op7_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.suffixes import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.mixing import plan_mix

    plan = plan_mix(documents(spark, sf_dir))
    first = F.get("copies", F.lit(0))["position"]
    return plan.withColumn("position", first).orderBy(F.col("position").asc_nulls_last(), "ord").select("doc_id", "size", "source_size", "target", "taken", "position")


def op9_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.decontam import decontaminate

    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_anchored_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.pii import scan_pii

    return scan_pii(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from skein.llm.sql import SQL

    return dict(SQL)
