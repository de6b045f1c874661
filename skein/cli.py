"""Command line: ``python -m skein.cli <command> ...``. Edge lists come as CSV with a header, results go to folders of CSV or JSON.

Commands take files of one graph each, named "<graph>_edge_list.csv"; environment variables JOBS (partitions of solver jobs) and SIZES are defaults of
the end-to-end run, as flags beat them. Every command is a function below, to be called with a session as well.
"""

from __future__ import annotations

import argparse
import os
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import header_slug, type_or_untyped
from skein.operators import common_subgraph as mcs
from skein.operators import graph as g
from skein.operators import patterns as pt
from skein.operators import sampling as sample
from skein.operators import strong, summary
from skein.operators import verification as v
from skein.operators.components import components
from skein.plans.staging import stage
from skein.sinks import tables as out
from skein.sinks import text as lines_of
from skein.sources import files
from skein.sources.edges import read_node_list

STRATEGIES = ("high_degree_bfs", "low_degree_bfs", "random_bfs", "degree_band_bfs", "random_nodes", "sparse_greedy")


def graphs_of(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Edges (src, dst) by graph name, staged once each."""
    found = {}
    for path in paths:
        rows = stage(files.tolerant_edges(spark, path), "edges")
        name = os.path.basename(path.rstrip("/")).removesuffix(".csv").removesuffix("_edge_list")
        if name in found:
            raise ValueError(f"two graphs are called {name}")
        found[name] = rows.select("src", "dst")
    return found


def together(graphs: dict[str, DataFrame]) -> DataFrame:
    """(graph, src, dst) of all graphs."""
    rows = None
    for name, e in graphs.items():
        part = e.select(F.lit(name).alias("graph"), "src", "dst")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def order_of(strategy: str, edges: DataFrame, seed: int, quantile: float = 0.35) -> list[Column]:
    if strategy == "low_degree_bfs":
        return sample.low_first()
    if strategy in ("random_bfs", "random_nodes"):
        return sample.hashed(seed)
    if strategy == "degree_band_bfs":
        return sample.band_first(sample.lower_quantile(g.total_degree(edges), quantile))
    return sample.high_first()


def sampled(edges: DataFrame, strategy: str, size: int, seed: int = 1) -> DataFrame:
    """Induced edges of a sample, loops left out; a size beyond the graph raises."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy} is none of {STRATEGIES}")
    if strategy == "sparse_greedy":
        nodes = sample.sparse_sample(edges, size)
    elif strategy == "random_nodes":
        nodes = sample.first_nodes(edges, size, order_of(strategy, edges, seed))
    else:
        nodes = sample.bfs_sample(edges, size, order_of(strategy, edges, seed), seed + size)
    return stage(g.without_loops(g.induced(edges.distinct(), nodes.select("node"))), "sample")


def _job(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    return mcs.edge_list(left, "left_edges").join(mcs.edge_list(right, "right_edges")).select(F.lit(name).alias("job"), "*")


def pairwise(graphs: dict[str, DataFrame], strategy: str, sizes: list[int], parts: int, branches: int = mcs.BRANCHES) -> tuple[DataFrame, DataFrame]:
    """Best mappings (mapping, pos, left_graph, right_graph, l, r) of all pairs and sizes, and a checked row for each; jobs run side by side."""
    samples = {(n, s): sampled(e, strategy, s) for n, e in graphs.items() for s in sizes}
    jobs, names = None, []
    for s in sizes:
        for a, b in combinations(graphs, 2):
            job = f"{a}--{b}.n{s}"
            names.append((job, a, b, s))
            row = _job(job, samples[a, s], samples[b, s])
            jobs = row if jobs is None else jobs.unionByName(row)
    solved = stage(mcs.solve_jobs(stage(jobs, "jobs").repartition(parts, "job"), branches), "incumbents")
    keys = solved.sparkSession.createDataFrame(names, "mapping string, left_graph string, right_graph string, size long")
    best = stage(mcs.best_mapping(solved).withColumnRenamed("job", "mapping").join(F.broadcast(keys), "mapping").select("mapping", "pos", "left_graph", "right_graph", "l", "r"), "mappings")
    state = solved.groupBy(F.col("job").alias("mapping")).agg(F.bool_and("complete").alias("complete"), F.max("error").alias("error"))
    return best, keys.drop("left_graph", "right_graph").join(state, "mapping").join(v.verify_pairs(best, together(graphs), loops=False), "mapping", "left")


def triplets(graphs: dict[str, DataFrame], strategy: str, size: int, parts: int, branches: int = mcs.BRANCHES) -> DataFrame:
    """Three-way matches: each triplet's pairs are solved, the best one is searched in the graph held out; rows (mapping, pos, side, graph, node)."""
    samples = {n: sampled(e, strategy, size) for n, e in graphs.items()}
    best, _ = pairwise(graphs, strategy, [size], parts, branches)
    found = None
    for three in combinations(graphs, 3):
        sizes = {(r["left_graph"], r["right_graph"]): r["n"] for r in best.where(F.col("left_graph").isin(*three) & F.col("right_graph").isin(*three)).groupBy("left_graph", "right_graph").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            continue
        a, b = max(sizes, key=lambda k: (sizes[k], k))
        held = next(x for x in three if x not in (a, b))
        pair = stage(best.where((F.col("left_graph") == a) & (F.col("right_graph") == b)).select("l", "r"), "pair")
        pattern = g.induced(samples[a], pair.select(F.col("l").alias("node")))
        third = mcs.best_mapping(mcs.solve_jobs(_job("third", pattern, samples[held]), branches)).select("pos", "l", F.col("r").alias("third"))
        met = third.join(pair, "l")
        sides = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(n).alias("graph"), F.col(c).alias("node")) for s, n, c in (("a", a, "l"), ("b", b, "r"), ("c", held, "third"))])
        rows = met.select(F.lit("-".join(three)).alias("mapping"), "pos", F.explode(sides).alias("x")).select("mapping", "pos", "x.*")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no pair of the graphs has a match")
    return stage(found, "threeway")


def _write(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def run(spark: SparkSession, a: argparse.Namespace) -> None:  # noqa: C901, PLR0912
    graphs = graphs_of(spark, a.graphs)
    first = next(iter(graphs.values()), None)
    if a.command == "sample":
        for name, e in graphs.items():
            for size in a.sizes:
                out.write_pattern(sampled(e, a.strategy, size, a.seed), f"{a.out}/{name}.n{size}.s{a.seed}", a.reuse)
    elif a.command == "pairwise":
        best, checked = pairwise(graphs, a.strategy, a.sizes, a.jobs, a.branches)
        _write(best, f"{a.out}/mappings")
        _write(checked, f"{a.out}/summary")
    elif a.command in ("triplet", "threeway"):
        corr = triplets(graphs, a.strategy, a.sizes[0], a.jobs, a.branches)
        rows = stage(v.verify_many(corr, together(graphs), ["a", "b", "c"]), "verified")
        _write(corr, f"{a.out}/threeway")
        _write(rows, f"{a.out}/detail")
        _write(rows.where("isomorphic"), f"{a.out}/isomorphic")
        metrics = ["nodes", "a_edges", "a_weak_components", "a_largest_weak", "a_strong_components", "a_largest_strong"]
        _write(summary.metric_stats(rows.where("isomorphic"), metrics), f"{a.out}/statistics")
        for side in "abc":
            lines_of.write_node_list(corr.where(F.col("side") == side).select("node"), f"{a.out}/nodes_{side}")
    elif a.command == "verify":
        wide = files.mapping_places(spark, a.mapping, a.sides)
        names = [r["graph"] for r in wide.where("pos = 0").select("graph").collect()]
        side = F.create_map(*[x for n, s in zip(names, "abc", strict=False) for x in (F.lit(n), F.lit(s))])
        corr = wide.select(F.lit(a.mapping).alias("mapping"), "pos", side[F.col("graph")].alias("side"), "graph", "node")
        _write(v.verify_many(corr, together(graphs), list("abc"[: len(names)])), f"{a.out}/verified")
    elif a.command in ("weak", "strong"):
        for name, e in graphs.items():
            of = components(e) if a.command == "weak" else strong.strong_components(e)
            out.write_components(stage(of, "components"), e.distinct(), name, "wcc" if a.command == "weak" else "scc", a.out)
    elif a.command == "component-pairs":
        sizes = None
        for name, e in graphs.items():
            part = components(e).groupBy("component").agg(F.count("*").alias("size")).select(F.lit(name).alias("graph"), "component", "size")
            sizes = part if sizes is None else sizes.unionByName(part)
        jobs = stage(pt.component_pairs(stage(sizes, "sizes"), a.least, a.gib), "jobs")
        _write(jobs, f"{a.out}/jobs")
        if not a.dry_run:
            members = None
            for name, e in graphs.items():
                part = components(e).select(F.lit(name).alias("graph"), "component", "node")
                members = part if members is None else members.unionByName(part)
            done = pt.solved_components(jobs, together(graphs), stage(members, "members"), a.branches)
            _write(done.groupBy("job").agg(F.max("size").alias("size"), F.bool_and("complete").alias("complete"), F.max("error").alias("error")), f"{a.out}/matches")
    elif a.command == "many":
        if a.max_nodes and max(g.nodes_of(e).count() for e in graphs.values()) > a.max_nodes:
            raise ValueError(f"a graph has more than {a.max_nodes} nodes")
        if not a.dry_run:
            _write(lines_of.wide_mapping(mcs.match_many(list(graphs.items()), a.branches), list(graphs)).orderBy("pos"), f"{a.out}/mapping")
    elif a.command == "patterns":
        _write(pt.common_patterns(stage(together(graphs).distinct(), "edges"), len(graphs), a.max_degree), f"{a.out}/patterns")
    elif a.command == "independent-set":
        for name, e in graphs.items():
            lines_of.write_node_list(sample.best_independent_set(e, a.trials), f"{a.out}/{name}")
    elif a.command == "hubs":
        e = g.induced(first.distinct(), read_node_list(spark, a.nodes)) if a.nodes else first.distinct()
        labels = stage(strong.strong_components(e), "scc")
        rows = stage(strong.component_features(e, labels), "features")
        _write(rows, f"{a.out}/features")
        _write(strong.node_roles(labels, rows).select("node", "component", "role", "dag_level"), f"{a.out}/roles")
    elif a.command == "outdegree":
        nodes = read_node_list(spark, a.nodes) if a.nodes else g.nodes_of(first)
        types = spark.read.option("header", True).csv(a.table).select(F.col("node").cast("bigint").alias("node"), "type")
        counted = g.induced(first, nodes).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
        rows = nodes.join(counted, "node", "left").join(types, "node", "left").select(type_or_untyped(F.col("type")).alias("cell_type"), F.coalesce("n", F.lit(0)).alias("od"))
        per = rows.groupBy("cell_type").agg(F.count("*").alias("cells"), F.bround(F.avg("od"), 4).alias("avg_outdegree"), F.median("od").alias("median_outdegree"), F.max("od").alias("max_outdegree"), F.sum("od").alias("total_outdegree"))
        _write(per, f"{a.out}/types")
        order = [F.desc("avg_outdegree"), F.desc("cells"), "cell_type"]
        lines_of.write_lines(spark.createDataFrame([(out.markdown(per.where(F.col("cells") >= a.least), order),)], "value string"), f"{a.out}/report.md")
    elif a.command == "modules":
        modules = spark.read.option("header", True).csv(a.table).select("module", "graph", F.col("node").cast("bigint").alias("node"))
        known = spark.read.option("header", True).csv(a.mapping).withColumn("node", F.col("node").cast("bigint"))
        rows = spark.read.option("header", True).csv(a.nodes).select("graph", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), F.col("syn_count").try_cast("bigint").alias("syn_count"), "neuropil", "nt_type")
        fields = [c for c in known.columns if c != "node"]
        done = summary.characterised(modules, rows, known.toDF(*[c if c == "node" else header_slug(c) for c in known.columns]), [header_slug(c) for c in fields])
        _write(done, f"{a.out}/modules")
    elif a.command == "revalidate":
        rows, pairs, index, e = (spark.read.option("header", True).csv(x) for x in (a.table, a.mapping, a.nodes, a.edges))
        whole = lambda df, *names: df.withColumns({n: F.col(n).cast("bigint") for n in names})
        _write(v.revalidate(rows, whole(pairs, "pos", "li", "ri"), whole(index, "idx", "node"), whole(e, "src", "dst")), f"{a.out}/revalidated")
    elif a.command == "runs":
        runs = [(p.rstrip("/").rsplit("/", 1)[-1], files.run_bundle(spark, p, {"rows": "detail"})["rows"].drop("run_name")) for p in a.runs]
        rows = stage(out.joined_runs(runs), "runs")
        _write(rows, f"{a.out}/combined_all_rows")
        _write(rows.where("isomorphic = 'true'"), f"{a.out}/combined_isomorphic_rows")
        _write(summary.metric_stats(rows.where("isomorphic = 'true'"), ["nodes", "a_edges", "a_weak_components", "a_largest_weak"], "run_name"), f"{a.out}/run_summary")
    elif a.command == "report":
        rows = g.total_degree(first).groupBy("degree").agg(F.count("*").alias("nodes"))
        lines_of.write_lines(spark.createDataFrame([(out.markdown(rows, [F.desc("nodes"), "degree"]),)], "value string"), f"{a.out}/report.md")
    elif a.command == "smoke":
        e = stage(pt.random_edges(spark, 20, 80_000, a.seed), "random")
        done = mcs.solve_jobs(_job("smoke", e, e)).where("error is null").agg(F.max("size")).first()[0]
        if done != g.nodes_of(e).count():
            raise SystemExit("smoke: the solver does not map a graph onto itself")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skein", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    names = ["sample", "pairwise", "triplet", "threeway", "verify", "weak", "strong", "component-pairs", "many", "patterns", "independent-set", "hubs", "outdegree", "modules", "revalidate", "runs", "report", "smoke"]
    for name in names:
        p = sub.add_parser(name)
        p.add_argument("graphs", nargs="*")
        p.add_argument("--out", default="out")
        p.add_argument("--strategy", choices=STRATEGIES, default=STRATEGIES[0])
        p.add_argument("--sizes", type=int, nargs="+", default=[int(x) for x in os.environ.get("SIZES", "1000 2000").split()])
        p.add_argument("--jobs", type=int, default=int(os.environ.get("JOBS", "2")))
        p.add_argument("--seed", type=int, default=1)
        p.add_argument("--branches", type=int, default=mcs.BRANCHES)
        p.add_argument("--mapping", default="")
        p.add_argument("--sides", type=int, default=2)
        p.add_argument("--nodes", default="")
        p.add_argument("--table", default="")
        p.add_argument("--edges", default="")
        p.add_argument("--runs", nargs="*", default=[])
        p.add_argument("--reuse", action="store_true")
        p.add_argument("--least", type=int, default=141)
        p.add_argument("--gib", type=float, default=24.0)
        p.add_argument("--max-nodes", type=int, default=0)
        p.add_argument("--max-degree", type=int, default=16)
        p.add_argument("--trials", type=int, default=4)
        p.add_argument("--dry-run", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("skein").getOrCreate(), args)


if __name__ == "__main__":
    main()
