"""Weak components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round links every node's larger neighbours, or its smaller ones, to the least node it knows; the edge
table shrinks to stars around the least node of each component in O(log n) or so rounds. A round
is two joins on plain exchanges of staged tables, so a star with very many leaves is split by
adaptive execution; minima are taken with map-side combining. Nothing comes to the driver but a count and
a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.staging import stage

#: Up to so many counted edges (a few MB) are contracted in one task; more take the distributed rounds.
ONE_TASK = 200_000


def _union_find(links: DataFrame) -> DataFrame:
    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.setdefault(x, x)) != x:
                root[x] = root[y]
                x = y
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = find(u), find(v)
                root[max(u, v)] = min(u, v)
        nodes = list(root)
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])

    return links.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(contracted, "node long, component long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v) with u > v; gives edges of the same form."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
    least = stage(least, "least")
    met = both.join(least, both["u"] == least["at"])
    if large:  # every larger neighbour moves to the least node
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # every smaller neighbour and the node itself do
        moved = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return stage(moved.where("u > v").distinct(), "star")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of the edges; the component is its least node. Self-loops keep their node.

    Directions don't matter; null ends and repeated edges are ignored.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct()
    pairs = stage(pairs, "edges")
    if pairs.count() <= ONE_TASK and dict(pairs.dtypes)["a"] in ("int", "bigint"):
        return _union_find(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    links = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stage(links, "links")
    before = None
    while True:
        mark = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        links = _star(_star(links, True), False)
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
