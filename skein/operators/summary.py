"""Summaries of tables of results: statistics, counts by condition, top values as text, rows for modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A number, or null where the text is none (blank and "nan" included)."""
    found = F.trim(text.cast("string")).try_cast("double")
    return F.when(F.isnan(found), None).otherwise(found)


def stats(value: Column) -> list[Column]:
    """min, max, mean and median; all null of no rows."""
    return [F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median")]


def metric_stats(rows: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """(by.., metric, n, min, max, mean, median): a row a metric, over values that are numbers; one aggregation for all."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), number(F.col(m)).alias("x")) for m in metrics])).alias("e"))
    return long.groupBy(*by, F.col("e.metric").alias("metric")).agg(F.count("e.x").alias("n"), *stats(F.col("e.x")))


def named(label: Column) -> Column:
    """The label if it says something: not null, blank or "nan"."""
    return label.isNotNull() & (F.trim(label) != "") & (F.lower(F.trim(label)) != "nan")


def value_counts(rows: DataFrame, label: str, *by: str) -> DataFrame:
    """(by.., label, n) of labels that say something."""
    return rows.where(named(F.col(label))).groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("n"))


def top_text(counts: DataFrame, by: list[str], most: int = 8, name: str = "top") -> DataFrame:
    """(by.., name): the ``most`` commonest labels of (by.., label, n) as "a:3; b:2", of a tie the least first."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "label"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= most)
    items = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "label", "n").alias("t"))))
    return best.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x["t"]), "; ").alias(name))


def top_and_other(counts: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """(by.., label, n): the commonest labels over all of ``by``, and "other" for the rest."""
    total = counts.groupBy("label").agg(F.sum("n").alias("total"))
    best = total.orderBy(F.desc("total"), "label").limit(most).select("label", F.lit(True).alias("kept"))
    met = counts.join(F.broadcast(best), "label", "left")
    return met.groupBy(*by, F.when(F.col("kept"), F.col("label")).otherwise("other").alias("label")).agg(F.sum("n").alias("n"))


def module_edges(modules: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (graph, src, dst, ..) that touch modules (module, graph, node), a row for each module, with their direction; all modules in two joins."""
    nodes = modules.select("module", "graph", "node").distinct()
    rows = rows.withColumn("edge_row", F.monotonically_increasing_id())
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("s"), F.lit(0).alias("d")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("s"), F.lit(1).alias("d")))
    met = rows.withColumn("e", F.explode(ends)).select(*rows.columns, "e.*").join(nodes, ["graph", "node"])
    per = met.groupBy("module", *rows.columns).agg(F.max("s").alias("s"), F.max("d").alias("d"))
    way = F.when((F.col("s") == 1) & (F.col("d") == 1), "internal").when(F.col("s") == 1, "outgoing").otherwise("incoming")
    return per.withColumn("direction", way).drop("s", "d", "edge_row")


def characterised(modules: DataFrame, rows: DataFrame, annotations: DataFrame, fields: list[str]) -> DataFrame:
    """A row per (module, graph): nodes, coverage by annotations (node, fields..), edge rows and weights each way, top values of facets and fields."""
    touching = module_edges(modules, rows)
    ways = ("internal", "outgoing", "incoming")
    counts = touching.groupBy("module", "graph").agg(*[F.count_if(F.col("direction") == w).alias(f"{w}_rows") for w in ways], *[F.coalesce(F.sum(F.when(F.col("direction") == w, F.col("syn_count"))), F.lit(0)).alias(f"{w}_syn") for w in ways])
    met = modules.select("module", "graph", "node").distinct().join(annotations.withColumn("hit", F.lit(1)), "node", "left")
    out = met.groupBy("module", "graph").agg(F.count_distinct("node").alias("nodes"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    out = out.withColumn("coverage", F.col("found") / F.greatest(F.lit(1), "nodes")).join(counts, ["module", "graph"], "left")
    for way, facet in (("internal", "neuropil"), ("internal", "nt_type"), ("outgoing", "neuropil"), ("incoming", "neuropil")):
        top = top_text(value_counts(touching.where(F.col("direction") == way), facet, "module", "graph"), ["module", "graph"], name=f"top_{way}_{facet}")
        out = out.join(top, ["module", "graph"], "left")
    for field in fields:
        out = out.join(top_text(value_counts(met, field, "module", "graph"), ["module", "graph"], name=f"top_{field}"), ["module", "graph"], "left")
    texts = [c for c in out.columns if c.startswith("top_")]
    return out.na.fill(0, [f"{w}_{x}" for w in ways for x in ("rows", "syn")]).na.fill("", texts)


def histogram(rows: DataFrame, value: str, bins: int, *by: str) -> DataFrame:
    """(by.., bin, n): equal bins between the least and the greatest value; the last one holds its upper end."""
    span = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = F.col(value)
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((x - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    return rows.where(x.isNotNull()).join(F.broadcast(span)).groupBy(*by, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def quartiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by.., q0, q1, q2, q3, q4), with interpolation."""
    return rows.groupBy(*by).agg(*[F.percentile(F.col(value), i / 4).alias(f"q{i}") for i in range(5)])
