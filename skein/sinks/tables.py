"""Result tables for readers: assignments and summaries of components, markdown, networks, pattern files, run folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import nodes_of, without_loops
from skein.plans.numbering import numbered
from skein.plans.staging import stage
from skein.sinks.text import dimacs_lines, write_lines


def ranked_sizes(assigned: DataFrame) -> DataFrame:
    """(component, size, rank): unique ranks from 1 by size, of a tie the lesser component first."""
    sizes = assigned.groupBy("component").agg(F.count("*").alias("size")).withColumn("neg", -F.col("size"))
    return numbered(sizes, [], ["neg", "component"], "rank", 1).drop("neg")


def assignments(assigned: DataFrame) -> DataFrame:
    """(node_id, component_id, component_size, component_size_rank) of (node, component)."""
    met = assigned.join(ranked_sizes(assigned), "component")
    return met.select(F.col("node").alias("node_id"), F.col("component").alias("component_id"), F.col("size").alias("component_size"), F.col("rank").alias("component_size_rank"))


def component_summary(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, singletons, nontrivial, largest, its fraction, and the ten largest sizes as text."""
    sizes = ranked_sizes(assigned)
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", "size"))))
    text = F.array_join(F.transform(top, lambda x: x["size"].cast("string")), ";")
    one = sizes.agg(F.sum("size").alias("nodes"), F.count("*").alias("components"), F.count_if(F.col("size") == 1).alias("singletons"), F.count_if(F.col("size") > 1).alias("nontrivial"), F.max("size").alias("largest"), (F.max("size") / F.sum("size")).alias("fraction"), text.alias("top10"))
    return one.join(edges.agg(F.count("*").alias("edges")))


def write_components(assigned: DataFrame, edges: DataFrame, graph: str, kind: str, path: str) -> None:
    """Assignments, components and the summary row of a graph, as CSV folders named by graph and kind (wcc or scc)."""
    rows = stage(assignments(assigned), "assignments")
    put = lambda df, name: df.write.mode("errorifexists").option("header", True).csv(f"{path}/{name}")
    put(rows, f"assignments/{graph}.{kind}_assignments.csv")
    put(ranked_sizes(assigned).select(F.col("component").alias("component_id"), "size", F.col("rank").alias("size_rank")), f"components/{graph}.{kind}_components.csv")
    put(component_summary(assigned, edges).withColumn("graph", F.lit(graph)), f"summary/{graph}.{kind}_summary.csv")


def markdown(rows: DataFrame, order: list, most: int = 20) -> str:
    """The first ``most`` rows as a markdown table; "_No rows matched this filter._" of none."""
    shown = rows.orderBy(*order).limit(most).collect()
    if not shown:
        return "_No rows matched this filter._"
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(rows.columns) + " |", "| " + " | ".join(["---"] * len(rows.columns)) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(x) for x in r) + " |" for r in shown])


def summary_json(rows: DataFrame) -> str:
    """One row as indented JSON with sorted keys."""
    return json.dumps(rows.first().asDict(True), indent=2, sort_keys=True, default=str)


def network(edges: DataFrame, attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, attributes.., out_degree, in_degree) and edges (from, to) of a drawing, loops left out."""
    e = without_loops(edges).select("src", "dst").distinct()
    out, into = (e.groupBy(F.col(c).alias("node")).agg(F.count("*").alias(n)) for c, n in (("src", "out_degree"), ("dst", "in_degree")))
    nodes = nodes_of(edges).join(attributes, "node", "left").join(out, "node", "left").join(into, "node", "left").na.fill(0, ["out_degree", "in_degree"])
    return nodes.withColumnRenamed("node", "id"), e.select(F.col("src").alias("from"), F.col("dst").alias("to"))


def there(spark, path: str) -> bool:
    """Whether a writer has finished a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_pattern(edges: DataFrame, path: str, reuse: bool = False) -> None:
    """A sample's or pattern's edges as CSV, its DIMACS lines and its index map, in one folder; what is there already stays if ``reuse``."""
    if reuse and there(edges.sparkSession, f"{path}/map.csv"):
        return
    lines, index = dimacs_lines(edges)
    edges.select(F.col("src").alias("source neuron id"), F.col("dst").alias("target neuron id")).write.mode("errorifexists").option("header", True).csv(f"{path}/edges.csv")
    write_lines(lines, f"{path}/pattern.dimacs")
    index.select((F.col("idx") - 1).alias("symsplit_index"), F.col("node").alias("node_id")).orderBy("symsplit_index").write.mode("errorifexists").option("header", True).csv(f"{path}/map.csv")


def mapped_nodes(pairs: DataFrame, left: DataFrame, right: DataFrame) -> tuple[DataFrame, int]:
    """(pos, l, r) of pairs of places (pos, li, ri) by index maps (idx, node); pairs out of range are left out, the number of those kept comes with it."""
    met = pairs.join(left.select(F.col("idx").alias("li"), F.col("node").alias("l")), "li").join(right.select(F.col("idx").alias("ri"), F.col("node").alias("r")), "ri")
    met = stage(met.select("pos", "l", "r"), "mapped")
    return met, met.count()


def joined_runs(runs: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows of runs by name, columns of the others null; each tagged with its run_name."""
    out = None
    for name, rows in runs:
        rows = rows.withColumn("run_name", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def with_ratios(rows: DataFrame) -> DataFrame:
    """The three ratios of a run's rows to its matched nodes; text that is no number, and no nodes, give null."""
    from skein.operators.summary import number

    nodes = number(F.col("threeway_nodes"))
    named = {"largest_weak_ratio": "largest_weak_component", "largest_strong_ratio": "largest_strong_component", "isolated_weak_ratio": "isolated_nodes_weak"}
    return rows.withColumns({k: F.try_divide(number(F.col(c)), nodes) for k, c in named.items()})

