"""DIMACS and KaHIP graphs, mapping tables and node lists. Places are given without bringing all nodes to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import nodes_of, without_loops
from skein.operators.sampling import neighbours
from skein.plans.numbering import numbered
from skein.plans.staging import stage


def placed(nodes: DataFrame, first: int = 1) -> DataFrame:
    """(node, idx): places by ascending id from ``first``."""
    return numbered(nodes.select("node").distinct(), [], ["node"], "idx", first)


def dimacs_lines(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value) lines "p edge n m" and "e u v", and the (node, idx) map; rows stay as they are, repeats and loops too."""
    index = stage(placed(nodes_of(edges)), "index")
    a, b = index.select(F.col("node").alias("src"), F.col("idx").alias("u")), index.select(F.col("node").alias("dst"), F.col("idx").alias("v"))
    rows = edges.join(a, "src").join(b, "dst").select(F.struct("u", "v").alias("at"), F.concat_ws(" ", F.lit("e"), "u", "v").alias("value"))
    head = index.agg(F.count("*").alias("n")).join(edges.agg(F.count("*").alias("m")))
    head = head.select(F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v")).alias("at"), F.concat_ws(" ", F.lit("p edge"), "n", "m").alias("value"))
    return head.unionByName(rows).orderBy("at").select("value"), index


def kahip_lines(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value) lines "n m" and each node's sorted neighbours, undirected and once, and the (node, idx) map."""
    index = stage(placed(nodes_of(edges)), "index")
    near = neighbours(edges).join(index, "node").select(F.col("idx").alias("u"), F.col("other").alias("node")).join(index, "node").select("u", F.col("idx").alias("v"))
    lists = near.groupBy("u").agg(F.array_join(F.array_sort(F.collect_list("v")), " ").alias("value"))
    rows = index.select(F.col("idx").alias("u")).join(lists, "u", "left").select("u", F.coalesce("value", F.lit("")).alias("value"))
    undirected = without_loops(edges).select(F.least("src", "dst"), F.greatest("src", "dst")).distinct()
    head = index.agg(F.count("*").alias("n")).join(undirected.agg(F.count("*").alias("m"))).select(F.lit(0).cast("long").alias("u"), F.concat_ws(" ", "n", "m").alias("value"))
    return head.unionByName(rows).orderBy("u").select("value"), index


def write_lines(lines: DataFrame, path: str) -> None:
    """Text parts whose names follow the order of the lines."""
    lines.write.mode("errorifexists").text(path)


def wide_mapping(mapping: DataFrame, graphs: list[str]) -> DataFrame:
    """(pos, one column a graph) of a long mapping (pos, graph, node)."""
    return mapping.groupBy("pos").pivot("graph", graphs).agg(F.max("node"))


def write_mapping(mapping: DataFrame, graphs: list[str], path: str) -> None:
    wide_mapping(mapping, graphs).orderBy("pos").select(*[F.col(f"`{g}`") for g in graphs]).write.mode("errorifexists").option("header", True).csv(path)


def write_node_list(nodes: DataFrame, path: str) -> None:
    write_lines(nodes.orderBy("node").select(F.col("node").cast("string").alias("value")), path)
