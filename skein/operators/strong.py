"""Strong components, their condensation, levels of the condensed graph, and the roles that nodes have in it.

Up to ``ONE_TASK`` counted edges (a few MB) are walked depth first in one task. More take the distributed way:
nodes without an edge in or out are peeled off, every other node learns the least node that reaches it (its colour), and the
nodes of a colour that reach their least node back are its component; the rest goes round again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import nodes_of
from skein.plans.staging import stage

ONE_TASK = 200_000
ROLES = ("source_hub", "recurrent_core", "intermediate", "sink")


def _in_one_task(edges: DataFrame, solve: Callable[[list[int], list[int]], dict[int, int]], name: str) -> DataFrame:
    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for batch in batches:
            src += batch.column(0).to_pylist()
            dst += batch.column(1).to_pylist()
        got = solve(src, dst)
        yield pa.record_batch([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], ["node", name])

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).coalesce(1).mapInArrow(solved, f"node long, {name} long")


def _tarjan(src: list[int], dst: list[int]) -> dict[int, int]:
    out: dict[int, list[int]] = {}
    for a, b in zip(src, dst, strict=True):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    of: dict[int, int] = {}
    open_nodes: list[int] = []
    for start in out:
        if start in order:
            continue
        path = [(start, iter(out[start]))]
        order[start] = low[start] = len(order)
        open_nodes.append(start)
        while path:
            node, rest = path[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    open_nodes.append(nxt)
                    path.append((nxt, iter(out[nxt])))
                    break
                if nxt not in of:
                    low[node] = min(low[node], order[nxt])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == order[node]:
                    cut = bisect_left(open_nodes, order[node], key=order.__getitem__)  # open nodes are in visiting order
                    members = open_nodes[cut:]
                    del open_nodes[cut:]
                    of |= dict.fromkeys(members, min(members))
    return of


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges whose ends have an edge in and one out, to a fixpoint."""
    n = edges.count()
    while n:
        ends = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        ends = stage(ends, "inner")
        kept = edges.join(ends.select(F.col("node").alias("src")), "src", "left_semi").join(ends.select(F.col("node").alias("dst")), "dst", "left_semi")
        edges = stage(kept.select("src", "dst"), "peeled")
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in components of two or more."""
    found = edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    edges = _peeled(edges)
    while not edges.isEmpty():
        colour = nodes_of(edges).select("node", F.col("node").alias("c"))
        mark = None
        while True:
            moved = edges.join(colour, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "c")
            colour = stage(colour.unionByName(moved).groupBy("node").agg(F.min("c").alias("c")), "colour")
            now = colour.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
            if now == mark:
                break
            mark = now
        a, b = colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("c").alias("cd"))
        edges = stage(edges.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst", "cs"), "inside")
        reached = front = stage(colour.where("node = c").select("node", F.col("c").alias("component")), "roots")
        while True:
            back = edges.join(front, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "component").distinct()
            front = stage(back.join(reached, "node", "left_anti"), "front")
            if front.isEmpty():
                break
            reached = stage(reached.unionByName(front), "reached")
        found = found.unionByName(reached)
        gone = reached.select("node")
        edges = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        edges = _peeled(stage(edges.select("src", "dst"), "rest"))
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src, dst); the component is its least node. Null ends are ignored."""
    pairs = stage(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    if pairs.count() <= ONE_TASK:
        return _in_one_task(pairs, _tarjan, "component")
    found = stage(_coloured(pairs.where("src <> dst")), "strong")
    return nodes_of(pairs).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def condensed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` as (src, dst) components, one row per edge; those within a component have equal ends."""
    a, b = labels.select(F.col("node").alias("src"), F.col("component").alias("cs")), labels.select(F.col("node").alias("dst"), F.col("component").alias("cd"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").select(F.col("cs").alias("src"), F.col("cd").alias("dst"))


def _longest(src: list[int], dst: list[int]) -> dict[int, int]:
    out: dict[int, list[int]] = {}
    waits: dict[int, int] = {}
    for a, b in zip(src, dst, strict=True):
        out.setdefault(a, []).append(b)
        waits.setdefault(a, 0)
        waits[b] = waits.get(b, 0) + 1
    level = {n: 0 for n, w in waits.items() if not w}
    ready = list(level)
    for node in ready:
        for nxt in out.get(node, ()):
            waits[nxt] -= 1
            if not waits[nxt]:
                level[nxt] = level[node] + 1
                ready.append(nxt)
    if len(level) < len(waits):
        raise ValueError("levels of a graph with cycles")
    return level


def dag_levels(edges: DataFrame) -> DataFrame:
    """(node, level) of an acyclic graph's distinct edges: edges on the longest path that ends in the node."""
    edges = stage(edges.select("src", "dst").distinct(), "dag")
    if edges.count() <= ONE_TASK:
        return _in_one_task(edges, _longest, "level")
    left, nodes, found, depth = edges, stage(nodes_of(edges), "nodes"), None, 0
    while not nodes.isEmpty():
        free = stage(nodes.join(left.select(F.col("dst").alias("node")), "node", "left_anti"), "free")
        if free.isEmpty():
            raise ValueError("levels of a graph with cycles")
        row = free.select("node", F.lit(depth).cast("long").alias("level"))
        found = row if found is None else found.unionByName(row)
        left = stage(left.join(free.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst"), "left")
        nodes = stage(nodes.join(free, "node", "left_anti"), "nodes")
        depth += 1
    return nodes.select("node", F.lit(0).cast("long").alias("level")) if found is None else found


def component_features(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per component: size, degrees and level in the condensed graph, edges out, in and inside, and the hub score."""
    rows = stage(condensed(edges, labels), "condensed")
    cross = rows.where("src <> dst")
    dag = cross.distinct()

    def ends(x: DataFrame, out: str, into: str) -> DataFrame:
        both = F.array(F.struct(F.col("src").alias("component"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("component"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        return x.select(F.explode(both).alias("e")).groupBy("e.component").agg(F.sum("e.o").alias(out), F.sum("e.i").alias(into))

    inside = rows.where("src = dst").groupBy(F.col("src").alias("component")).agg(F.count("*").alias("internal_edges"))
    found = labels.groupBy("component").agg(F.count("*").alias("size"))
    for part in (ends(dag, "dag_outdegree", "dag_indegree"), ends(cross, "external_out_edges", "external_in_edges"), inside, dag_levels(dag).select(F.col("node").alias("component"), F.col("level").alias("dag_level"))):
        found = found.join(part, "component", "left")
    found = found.na.fill(0)
    out, into, eout, ein = (F.col(c) for c in ("dag_outdegree", "dag_indegree", "external_out_edges", "external_in_edges"))
    hub = (out >= 2) & (out > into) & (eout >= ein)
    return found.withColumns({"source_like_score": (out - into) + (eout - ein), "is_source": into == 0, "is_source_like_hub": hub})


def role(core: Column) -> Column:
    """The role of a component's nodes; the first that fits of core, hub, sink, intermediate."""
    sink = (F.col("dag_outdegree") == 0) & (F.col("dag_indegree") > 0)
    return F.when(core, "recurrent_core").when(F.col("is_source_like_hub"), "source_hub").when(sink, "sink").otherwise("intermediate")


def node_roles(labels: DataFrame, features: DataFrame) -> DataFrame:
    """(node, component, role, ...): the core is the largest component, of a tie the one of the least id."""
    features = stage(features, "features")
    core = features.agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("core"))
    roles = features.join(F.broadcast(core)).withColumn("role", role(F.col("component") == F.col("core"))).drop("core")
    return labels.join(roles, "component")


def enrichment(rows: DataFrame, label: str, least: int = 3) -> DataFrame:
    """Per (role, label) with ``least`` rows or more: share in the role over share in all ``rows``."""
    by = rows.groupBy("role", F.col(label).alias("annotation")).agg(F.count("*").alias("role_count"))
    by = stage(by, "roles")
    of_role = by.groupBy("role").agg(F.sum("role_count").alias("r"))
    of_label = by.groupBy("annotation").agg(F.sum("role_count").alias("background_count"))
    total = by.agg(F.sum("role_count").alias("n"))
    met = by.where(F.col("role_count") >= least).join(of_role, "role").join(of_label, "annotation").join(F.broadcast(total))
    part, whole = F.col("role_count") / F.col("r"), F.col("background_count") / F.col("n")
    shown = {"role_fraction": part, "background_fraction": whole, "fold_enrichment": part / whole}
    return met.select("role", "annotation", "role_count", "background_count", *[F.bround(v, 4).alias(k) for k, v in shown.items()])
