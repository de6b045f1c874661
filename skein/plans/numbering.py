"""Places of rows in an order, without a task that holds a whole group: range parts are counted, then numbered side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.staging import stage


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "idx", first: int = 0) -> DataFrame:
    """``rows`` with the place of each by ``order`` (ascending, unique within a group) among the rows of its group ``by``, from ``first`` on.

    What meets in one task is a row for each part and group, not the rows of a group.
    """
    parts = stage(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "parts")
    counts = parts.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    turn = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    same = F.lit(True)
    for c in [*by, "__part"]:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}"))
    placed = parts.withColumn("__turn", turn).alias("p").join(starts.alias("s"), same)
    return placed.select(*[F.col(f"p.{c}") for c in rows.columns], (F.col("__start") + F.col("__turn") - 1 + first).cast("long").alias(name))
