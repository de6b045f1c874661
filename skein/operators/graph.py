"""Relational operators over edge tables: induced subgraphs, degrees, agreement of mapped graphs, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nodes_of(edges: DataFrame, *keep: str) -> DataFrame:
    return edges.select(*keep, F.explode(F.array("src", "dst")).alias("node")).distinct()


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (node); duplicates stay. Spark broadcasts the node set if it is small."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)


def boundary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` that touch ``nodes``, with their direction: internal, outgoing or incoming."""
    a = nodes.select(F.col("node").alias("src"), F.lit(True).alias("s")).distinct()
    b = nodes.select(F.col("node").alias("dst"), F.lit(True).alias("d")).distinct()
    kind = F.when(F.col("s") & F.col("d"), "internal").when(F.col("s"), "outgoing").when(F.col("d"), "incoming")
    return edges.join(a, "src", "left").join(b, "dst", "left").withColumn("direction", kind).where("direction is not null").select(*edges.columns, "direction")


def total_degree(edges: DataFrame, *keep: str) -> DataFrame:
    """One for each end of each row."""
    return edges.select(*keep, F.explode(F.array("src", "dst")).alias("node")).groupBy(*keep, "node").agg(F.count("*").alias("degree"))


def distinct_degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours out and in, loops included."""
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def agreement(edges: DataFrame) -> DataFrame:
    """For each edge, in how many graphs it is; loops don't count."""
    return without_loops(edges).groupBy("src", "dst").agg(F.count_distinct("graph").alias("graphs"))


def density(m: Column, n: Column) -> Column:
    return m / F.greatest(F.lit(1), n * (n - 1))


def pair_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges in one of two edge sets only, with the side that lacks them."""
    a, b = (without_loops(x).select("src", "dst").distinct() for x in (left, right))
    return a.exceptAll(b).withColumn("status", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("status", F.lit("extra")))


def positional(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges as positions of a mapping (pos, node); a node that occurs again counts at its last position."""
    last = mapping.groupBy("node").agg(F.max("pos").alias("pos"))
    s, d = last.select(F.col("node").alias("src"), F.col("pos").alias("src_pos")), last.select(F.col("node").alias("dst"), F.col("pos").alias("dst_pos"))
    return without_loops(edges).join(s, "src").join(d, "dst").select("src_pos", "dst_pos").distinct()


def collapse(rows: DataFrame) -> DataFrame:
    """One row per pair: sum, rows and the commonest neuropil (the least of a tie)."""
    return rows.groupBy("src", "dst").agg(F.sum("syn_count").alias("syn_count"), F.count("*").alias("rows"), F.coalesce(F.mode("neuropil", True), F.lit("")).alias("neuropil"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """2 * (edges - undirected pairs) / edges without loops."""
    e = without_loops(edges).select("src", "dst").distinct().select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    per = e.groupBy("a", "b").agg(F.count("*").alias("k"))
    return per.agg(F.sum("k").alias("edges"), (2.0 * (F.sum("k") - F.count("*")) / F.sum("k")).alias("reciprocity"))


def clustering(edges: DataFrame) -> DataFrame:
    """Mean local clustering of the undirected simple graph over all nodes, zeros included."""
    u = without_loops(edges).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = u.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))
    # each triangle once: edges point from the end of lower degree, so no wedge list grows beyond the square root of the edges
    da, db = degree.select(F.col("node").alias("a"), F.col("k").alias("ka")), degree.select(F.col("node").alias("b"), F.col("k").alias("kb"))
    turned = u.join(da, "a").join(db, "b").select(F.when((F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb"))), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).alias("e")).select("e.*")
    x, y = turned.select("a", F.col("b").alias("p")), turned.select("a", F.col("b").alias("q"))
    wedges = x.join(y, "a").where("p < q")
    closed = wedges.join(u.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"])
    triangles = closed.select(F.explode(F.array("a", "p", "q")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    every = nodes_of(edges)
    local = every.join(degree, "node", "left").join(triangles, "node", "left").select(F.when(F.col("k") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("c"))
    return local.agg(F.count("*").alias("nodes"), F.avg("c").alias("clustering"))


def weighted_degrees(rows: DataFrame, *keep: str) -> DataFrame:
    """Sums of syn_count over a node's rows out, in and both; a loop counts in all of them."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("syn_count").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).cast("long").alias("o"), F.col("syn_count").alias("i")))
    per = rows.select(*keep, F.explode(ends).alias("e")).groupBy(*keep, "e.node").agg(F.sum("e.o").alias("weighted_out"), F.sum("e.i").alias("weighted_in"))
    return per.withColumn("weighted", F.col("weighted_out") + F.col("weighted_in"))


def within_two_hops(edges: DataFrame, node: int) -> DataFrame:
    """(node, hop) of the neighbours of a node and of theirs, whatever the direction; each at its least hop, the node itself at 0."""
    near = without_loops(edges).select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct()
    one = near.where(F.col("src") == node).select(F.col("dst").alias("node"))
    two = near.join(one.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"))
    start = nodes_of(edges).where(F.col("node") == node).select("node", F.lit(0).alias("hop"))
    every = start.unionByName(one.withColumn("hop", F.lit(1))).unionByName(two.withColumn("hop", F.lit(2)))
    return every.groupBy("node").agg(F.min("hop").alias("hop"))
