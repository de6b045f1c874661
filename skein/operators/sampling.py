"""Node samples of bounded size and independent sets.

Breadth-first samples go level by level: the queue's order is (place of the first parent, rank among its neighbours), so a level is
one join with the frontier and a top-k. Where the first component ends before the sample is full, the sizes of the others tell at which
place each begins, and their levels are taken together. Frontier and sample are at most ``size`` rows, and ``size`` at most ``MOST``;
only they come to the driver. Of a node with more than 32 neighbours, the first 32 are shuffled by a hash of the seed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.components import components
from skein.operators.graph import nodes_of, total_degree, without_loops
from skein.plans.staging import stage

MOST = 100_000
HEAD = 32
POOL = 64


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other), both directions, once, without loops."""
    e = without_loops(edges)
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()


def _checked(degrees: DataFrame, size: int) -> DataFrame:
    if not 0 <= size <= MOST:
        raise ValueError(f"sample size {size} is not within 0 and {MOST}")
    degrees = stage(degrees, "degrees")
    if size > (n := degrees.count()):
        raise ValueError(f"sample of {size} from {n} nodes")
    return degrees


def high_first() -> list[Column]:
    return [-F.col("degree"), F.col("node")]


def low_first() -> list[Column]:
    return [F.col("degree"), F.col("node")]


def hashed(seed: int) -> list[Column]:
    return [F.xxhash64("node", F.lit(seed)), F.col("node")]


def band_first(pivot: int) -> list[Column]:
    return [F.abs(F.col("degree") - F.lit(pivot)), F.col("degree"), F.col("node")]


def lower_quantile(degrees: DataFrame, q: float) -> int:
    """The degree at place int((n - 1) * q) in ascending order, from the counts of each degree."""
    counts = degrees.groupBy("degree").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("degree"))  # one row per distinct degree
    total = degrees.count()
    return counts.withColumn("upto", upto).where(F.col("upto") > int((total - 1) * q)).agg(F.min("degree")).first()[0]


def bfs_sample(edges: DataFrame, size: int, order: list[Column], seed: int = 1, degrees: DataFrame | None = None) -> DataFrame:
    """(pos, node): the first ``size`` nodes of a breadth-first walk; starts and neighbours come in ``order``."""
    spark, among = edges.sparkSession, degrees is not None
    degrees = _checked(degrees if among else total_degree(edges), size)
    ranked = degrees.select("node", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("key"))
    ranked = stage(ranked, "ranked")
    adjacent = neighbours(edges)
    if among:
        adjacent = adjacent.join(ranked.select("node"), "node", "left_semi").join(ranked.select(F.col("node").alias("other")), "other", "left_semi").select("node", "other")
    adjacent = stage(adjacent, "adjacent")
    taken: list[tuple[int, int]] = []

    def walk(front: list[tuple[int, int]]) -> None:
        """Breadth-first from (pos, node) of components whose places follow each other, a level of all of them at a time."""
        first, upto = [pos for pos, _ in front], [pos + 1 for pos, _ in front]
        taken.extend(front)
        while front and len(taken) < size:
            seen = spark.createDataFrame(taken, "pos long, node long")
            at = spark.createDataFrame(front, "pos long, parent long")
            met = adjacent.join(F.broadcast(at), F.col("node") == F.col("parent")).select("pos", F.col("other").alias("node")).join(ranked, "node")
            head = met.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy("key"))).where(F.col("r") <= HEAD)
            many = met.groupBy("pos").agg(F.count("*").alias("n")).where(F.col("n") > HEAD).select("pos")
            head = head.join(many, "pos").select("pos", "node", F.xxhash64("node", "pos", F.lit(seed)).alias("h"))
            place = F.struct("pos", F.col("h").isNull().alias("tail"), F.coalesce("h", F.lit(0)).alias("h"), "key")
            fresh = met.join(head, ["pos", "node"], "left").withColumn("place", place).groupBy("node").agg(F.min("place").alias("place"))
            fresh = fresh.join(F.broadcast(seen.select("node")), "node", "left_anti").orderBy("place").limit(size - len(taken))
            front = []
            for r in fresh.select("place.pos", "node").collect():
                of = bisect_right(first, r["pos"]) - 1
                if upto[of] < size:  # only the last component may have more nodes than places
                    front.append((upto[of], r["node"]))
                    upto[of] += 1
            taken.extend(front)
            if upto[-1] == size:
                front = [x for x in front if x[0] < first[-1]]

    if size:
        walk([(0, ranked.orderBy("key").first()["node"])])
    if len(taken) < size:
        rest = ranked.join(stage(components(adjacent, "node", "other"), "components"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        of = rest.groupBy("component").agg(F.min(F.struct("key", "node")).alias("start"), F.count("*").alias("n")).where(F.col("start.node") != taken[0][1])
        starts, pos = [], len(taken)
        for r in of.orderBy("start").limit(size - pos).select("start.node", "n").collect():
            if pos < size:
                starts.append((pos, r["node"]))
                pos += r["n"]
        walk(starts)
    return spark.createDataFrame(sorted(taken), "pos long, node long")


def first_nodes(edges: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """(pos, node): the first ``size`` nodes in ``order``; with ``hashed`` a uniform sample."""
    degrees = _checked(total_degree(edges), size)
    first = stage(degrees.orderBy(*order).limit(size).select("node", F.struct(*order).alias("key")), "first")
    return first.select((F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("pos"), "node")


def sparse_sample(edges: DataFrame, size: int, pool: int = POOL) -> DataFrame:
    """(pos, node): again and again, of the ``pool`` nodes of least degree left, the one with fewest chosen neighbours.

    Only the first size + pool nodes by (degree, node) can be looked at, so one task of bounded size does it.
    """
    degrees = _checked(total_degree(edges), size)
    looked = stage(degrees.orderBy("degree", "node").limit(size + pool), "looked")
    near = neighbours(edges).join(F.broadcast(looked.select("node")), "node", "left_semi").join(F.broadcast(looked.select(F.col("node").alias("other"))), "other", "left_semi")
    lists = near.groupBy("node").agg(F.collect_list("other").alias("others"))

    def picked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["degree", "node"])
        others = {n: ([] if o is None else list(o)) for n, o in zip(rows["node"], rows["others"], strict=True)}
        left, out, met = rows["node"].tolist(), [], dict.fromkeys(rows["node"], 0)
        while len(out) < size:
            best = min(range(min(pool, len(left))), key=lambda i: (met[left[i]], i))
            out.append(left.pop(best))
            for o in others[out[-1]]:
                met[o] += 1
        yield pd.DataFrame({"pos": range(len(out)), "node": out})

    if not size:
        return edges.sparkSession.createDataFrame([], "pos long, node long")
    return looked.join(lists, "node", "left").coalesce(1).mapInPandas(picked, "pos long, node long")


def independent_sets(edges: DataFrame, trials: int) -> DataFrame:
    """(trial, node): maximal independent sets, greedy in the order of (degree, hash of node and trial).

    A node joins once it comes before all its neighbours that are left; this gives the greedy set in few rounds, all
    trials together.
    """
    near = neighbours(edges)
    degree = near.groupBy("node").agg(F.count("*").alias("d"))
    nodes = nodes_of(edges).join(degree, "node", "left").select("node", F.coalesce("d", F.lit(0)).alias("d"))
    turns = F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")
    left = nodes.select("node", "d", turns).select("trial", "node", F.struct("d", F.xxhash64("node", "trial").alias("h"), "node").alias("key"))
    left, found, near = stage(left, "left"), None, stage(near, "near")
    while not left.isEmpty():
        other = left.select("trial", F.col("node").alias("other"), F.col("key").alias("k"))
        least = left.join(near, "node").join(other, ["trial", "other"]).groupBy("trial", "node").agg(F.min("k").alias("k"))
        won = stage(left.join(least, ["trial", "node"], "left").where(F.col("k").isNull() | (F.col("key") < F.col("k"))).select("trial", "node"), "won")
        found = won if found is None else found.unionByName(won)
        gone = won.unionByName(won.join(near, "node").select("trial", F.col("other").alias("node")))
        left = stage(left.join(gone, ["trial", "node"], "left_anti"), "left")
    return left.select("trial", "node") if found is None else found


def best_independent_set(edges: DataFrame, trials: int = 4) -> DataFrame:
    """(node) of the largest of the trials' sets, the first of a tie."""
    sets = stage(independent_sets(edges, trials), "sets")
    best = sets.groupBy("trial").agg(F.count("*").alias("n")).agg(F.max_by("trial", F.struct("n", -F.col("trial"))).alias("trial"))
    return sets.join(F.broadcast(best), "trial").select("node")
