"""Maximum common induced subgraphs of directed samples, by splitting label classes (McCreesh, Prosser and Trimble's McSplit).

A job is one row that holds two samples of bounded size, so jobs spread over tasks and none looks at a whole graph.
A class holds nodes of both sides that agree with the mapping so far on edges in and out; loops don't count. The
search ends after a number of branches, not after a time, so reruns agree; it gives every mapping that was the largest when found. A
job that fails gives one row with its error and no pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NODES = 2000
BRANCHES = 20_000
SCHEMA = "job string, ordinal int, size int, complete boolean, pairs array<struct<l:bigint,r:bigint>>, error string"

Classes = list[tuple[list[int], list[int]]]


def _outs(edges: list[tuple[int, int]]) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for a, b in edges:
        out.setdefault(a, set())
        out.setdefault(b, set())
        if a != b:
            out[a].add(b)
    return out


def _ranked(out: dict[int, set[int]]) -> list[int]:
    degree = dict.fromkeys(out, 0)
    for a, bs in out.items():
        degree[a] += len(bs)
        for b in bs:
            degree[b] += 1
    return sorted(out, key=lambda n: (-degree[n], n))


def _split(classes: Classes, v: int, w: int, left: dict[int, set[int]], right: dict[int, set[int]]) -> Classes:
    parts: Classes = []
    for ls, rs in classes:
        by: dict[tuple[bool, bool], tuple[list[int], list[int]]] = {}
        for side, nodes, chosen, out in ((0, ls, v, left), (1, rs, w, right)):
            for n in nodes:
                if n != chosen:
                    by.setdefault((n in out[chosen], chosen in out[n]), ([], []))[side].append(n)
        parts += [p for p in by.values() if p[0] and p[1]]
    return parts


def common_subgraphs(left_edges: list[tuple[int, int]], right_edges: list[tuple[int, int]], branches: int = BRANCHES) -> tuple[list[list[tuple[int, int]]], bool]:
    """Mappings of growing size, and whether the last is known to be the largest."""
    left, right = _outs(left_edges), _outs(right_edges)
    if max(len(left), len(right)) > MOST_NODES:
        raise ValueError(f"samples of more than {MOST_NODES} nodes")
    found: list[list[tuple[int, int]]] = []
    spent = 0

    def search(mapping: list[tuple[int, int]], classes: Classes) -> bool:
        nonlocal spent
        spent += 1
        if mapping and (not found or len(mapping) > len(found[-1])):
            found.append(list(mapping))
        while classes and len(mapping) + sum(min(len(a), len(b)) for a, b in classes) > (len(found[-1]) if found else 0):
            at = min(range(len(classes)), key=lambda i: max(len(classes[i][0]), len(classes[i][1])))
            v, *rest = classes[at][0]
            for w in classes[at][1]:
                if spent >= branches:
                    return False
                if not search([*mapping, (v, w)], _split(classes, v, w, left, right)):
                    return False
            classes = [*classes[:at], *([(rest, classes[at][1])] if rest else []), *classes[at + 1 :]]
        return True

    deepest = sys.getrecursionlimit()
    sys.setrecursionlimit(max(deepest, 4 * MOST_NODES))
    try:
        done = search([], [(_ranked(left), _ranked(right))]) if left and right else True
    finally:
        sys.setrecursionlimit(deepest)
    return found, done


def solve_jobs(jobs: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """Incumbents of jobs (job, left_edges, right_edges); the edges are arrays of structs (src, dst)."""

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for job, a, b in frame.itertuples(index=False):
                try:
                    found, done = common_subgraphs(*([(int(e["src"]), int(e["dst"])) for e in x] for x in (a, b)), branches)
                    rows = [(job, i, len(m), done, [{"l": x, "r": y} for x, y in m], None) for i, m in enumerate(found)]
                except (ValueError, TypeError, RecursionError) as error:  # the other jobs go on; the row says why this one didn't
                    rows = [(job, 0, 0, False, [], f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(rows, columns=["job", "ordinal", "size", "complete", "pairs", "error"])

    return jobs.select("job", "left_edges", "right_edges").mapInPandas(solved, SCHEMA)


def best_mapping(incumbents: DataFrame) -> DataFrame:
    """(job, pos, l, r) of each job's largest mapping, the latest of a tie."""
    best = incumbents.where("error is null").groupBy("job").agg(F.max_by("pairs", F.struct("size", "ordinal")).alias("pairs"))
    return best.select("job", F.posexplode("pairs").alias("pos", "p")).select("job", F.col("pos").cast("long").alias("pos"), "p.l", "p.r")


def edge_list(edges: DataFrame, name: str) -> DataFrame:
    """All edges of a bounded sample as one row with one array."""
    return edges.agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias(name))


def match_many(graphs: list[tuple[str, DataFrame]], branches: int = BRANCHES) -> DataFrame:
    """(pos, graph, node) of a common induced subgraph of several samples by name: what the first two share is searched in the next one.

    Each search's pattern is what is left of the first sample; the mappings of the others follow it.
    """
    (name, first), *others = graphs
    from skein.operators.graph import induced, nodes_of, without_loops
    from skein.plans.staging import stage

    pattern = without_loops(first)
    corr = nodes_of(first).select(F.col("node").alias("key"), F.lit(name).alias("graph"), "node")
    for other, edges in others:
        jobs = edge_list(pattern, "left_edges").join(edge_list(without_loops(edges), "right_edges")).select(F.lit(other).alias("job"), "*")
        found = stage(best_mapping(solve_jobs(jobs, branches)), "match")
        corr = corr.join(found.select(F.col("l").alias("key")), "key", "left_semi").unionByName(found.select(F.col("l").alias("key"), F.lit(other).alias("graph"), F.col("r").alias("node")))
        pattern = stage(induced(pattern, found.select(F.col("l").alias("node"))), "pattern")
    last = found.select(F.col("l").alias("key"), "pos")
    return corr.join(last, "key").select("pos", "graph", "node")
