"""Text that solvers print: blocks of a metrics line and the pairs after it, names of result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a metrics line and a pair line look like.
METRICS = r"^\d+,\s*"
METRIC_FIELDS = 10
PAIR = r"^M\s+(\d+)\s+(\d+)\s*$"


def log_blocks(lines: DataFrame, *job: str) -> DataFrame:
    """(job.., block, metrics, pairs) of lines (job.., line_no, value); blocks of a job count from 1 and stand in one task each.

    Lines before the first metrics line belong to no block. Pairs (l, r) are places from 0, in the order of the lines.
    """
    fields = F.split("value", ",")
    starts = F.col("value").rlike(METRICS) & (F.size(fields) >= METRIC_FIELDS)
    turn = Window.partitionBy(*job).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("starts", starts).withColumn("block", F.sum(F.col("starts").cast("long")).over(turn)).where("block > 0")
    metrics = F.max(F.when(F.col("starts"), F.transform(fields, lambda x: F.trim(x))))
    at = F.struct("line_no", F.regexp_extract("value", PAIR, 1).try_cast("bigint").alias("l"), F.regexp_extract("value", PAIR, 2).try_cast("bigint").alias("r"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("value").rlike(PAIR), at)))
    found = rows.groupBy(*job, "block").agg(metrics.alias("metrics"), pairs.alias("p"))
    return found.select(*job, "block", "metrics", F.transform("p", lambda x: F.struct(x["l"].alias("l"), x["r"].alias("r"))).alias("pairs"))


def named_parts(name: Column, pattern: str, fields: list[str]) -> Column:
    """A struct of a pattern's groups in a file name; all null where it doesn't match."""
    return F.struct(*[F.when(name.rlike(pattern), F.regexp_extract(name, pattern, i + 1)).alias(f) for i, f in enumerate(fields)])


def summary_values(lines: DataFrame) -> DataFrame:
    """(key, text) of lines "- key: text" (line_no, value); the last line of a key counts."""
    key = F.trim(F.regexp_replace(F.regexp_extract("value", r"^([^:]+):", 1), r"^-\s*", ""))
    rows = lines.select("line_no", key.alias("key"), F.trim(F.regexp_extract("value", r"^[^:]+:(.*)$", 1)).alias("text")).where("key <> ''")
    return rows.groupBy("key").agg(F.max_by("text", "line_no").alias("text"))
