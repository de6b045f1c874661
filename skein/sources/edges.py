"""Edge tables (graph, src, dst). Nodes come from all edges, loops included, before any filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.sources.files import mapping_places

GRAPHS = ("A", "N", "R")


def read_edge_list(spark: SparkSession, path: str, src: str = "source neuron id", dst: str = "target neuron id") -> DataFrame:
    """(src, dst) of a CSV edge list with a header; raises if the header lacks a column. Duplicates and loops stay."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if missing := {src, dst} - set(raw.columns):
        raise ValueError(f"edge list without {sorted(missing)}")
    return raw.select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst"))


def read_node_list(spark: SparkSession, path: str) -> DataFrame:
    """(node) of a text file with one id a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").select(F.col("v").cast("bigint").alias("node"))


def read_mapping(spark: SparkSession, path: str, graphs: int = 2) -> DataFrame:
    """(pos, graph, node): the first columns of a mapping, whose header names the graphs, in long form; pos is the row's place in the file."""
    return mapping_places(spark, path, graphs)


def succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, src, dst, syn_count, neuropil, nt_type): parts that follow each other in an order, a row each."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    turn = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = lines.select(F.col("l_returnflag").alias("graph"), F.col("l_partkey").cast("long").alias("src"), F.lead("l_partkey").over(turn).cast("long").alias("dst"), F.col("l_quantity").cast("long").alias("syn_count"), F.col("l_linestatus").alias("neuropil"), F.col("l_returnflag").alias("nt_type"))
    return rows.where("dst is not null and syn_count >= 40")


def edges_of(spark: SparkSession, sf_dir: str, graph: str | None = None) -> DataFrame:
    """Distinct (graph, src, dst), loops kept; of one graph without the graph column if it is named."""
    rows = succession(spark, sf_dir).select("graph", "src", "dst").distinct()
    return rows if graph is None else rows.where(F.col("graph") == graph).select("src", "dst")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("node"), F.col("p_type").alias("primary_type"), F.col("p_brand").alias("sub_class"), F.col("p_size").cast("int").alias("size"))
