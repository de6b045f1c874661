"""Small patterns that several graphs share: connected sets of three nodes, their signatures, and where they occur.

A node's label is its number of distinct out- and in-neighbours, loops included. A pattern's key is the least of its
six arrangements of labels and edges, so equal keys are induced isomorphisms that keep labels, and no search is needed.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.numbering import numbered


def labels(edges: DataFrame) -> DataFrame:
    """(graph, node, outs, ins) of distinct edges (graph, src, dst)."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select("graph", "src", "dst").distinct().select("graph", F.explode(ends).alias("e")).groupBy("graph", "e.node").agg(F.sum("e.o").alias("outs"), F.sum("e.i").alias("ins"))


def label_counts(marked: DataFrame) -> DataFrame:
    """(outs, ins, graphs, least): how many graphs have a label, and its least count in one of them."""
    by = marked.groupBy("outs", "ins", "graph").agg(F.count("*").alias("n"))
    return by.groupBy("outs", "ins").agg(F.count("*").alias("graphs"), F.min("n").alias("least"))


def feasible(needs: DataFrame, counts: DataFrame, graphs: int) -> DataFrame:
    """(pattern, feasible) of needs (pattern, outs, ins, needed): every label is in all graphs often enough."""
    met = needs.join(counts, ["outs", "ins"], "left")
    enough = (F.coalesce("graphs", F.lit(0)) == graphs) & (F.coalesce("least", F.lit(0)) >= F.col("needed"))
    return met.groupBy("pattern").agg(F.bool_and(enough).alias("feasible"))


def smallest_graph(nodes: DataFrame) -> DataFrame:
    """The graph with the fewest nodes of (graph, node); the first by name of a tie."""
    return nodes.groupBy("graph").agg(F.count("*").alias("nodes")).orderBy("nodes", "graph").limit(1)


def seeds(marked: DataFrame, counts: DataFrame, graphs: int, max_degree: int) -> DataFrame:
    """Nodes with labels that all graphs have and at most ``max_degree`` neighbours, with the key they are tried by: (rarity, degree, node)."""
    common = marked.join(counts.where(F.col("graphs") == graphs).select("outs", "ins"), ["outs", "ins"])
    rarity = common.groupBy("graph", "outs", "ins").agg(F.count("*").alias("rarity"))
    met = common.join(rarity, ["graph", "outs", "ins"]).withColumn("degree", F.col("outs") + F.col("ins"))
    return met.where(F.col("degree") <= max_degree).select("graph", "node", "rarity", "degree")


def triples(edges: DataFrame, seeds_of: DataFrame) -> DataFrame:
    """(graph, x, y, z), x < y < z: sets of three seeds that hang together, by pairs of neighbours of one of them.

    A seed's degree is bounded, so is its number of pairs.
    """
    e = edges.where("src <> dst").select("graph", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ok = seeds_of.select("graph", "node")
    e = e.join(ok.withColumnRenamed("node", "a"), ["graph", "a"], "left_semi").join(ok.withColumnRenamed("node", "b"), ["graph", "b"], "left_semi")
    near = e.select("graph", F.explode(F.array(F.struct(F.col("a").alias("m"), F.col("b").alias("o")), F.struct(F.col("b").alias("m"), F.col("a").alias("o")))).alias("x")).select("graph", "x.*")
    met = near.alias("p").join(near.alias("q"), (F.col("p.graph") == F.col("q.graph")) & (F.col("p.m") == F.col("q.m")) & (F.col("p.o") < F.col("q.o")))
    three = F.array_sort(F.array("p.m", "p.o", "q.o"))
    return met.select("p.graph", three.alias("t")).distinct().select("graph", *[F.col("t")[i].alias(c) for i, c in enumerate("xyz")])


def induced_matrix(sets: DataFrame, edges: DataFrame, nodes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``sets`` with a 0/1 column a_b for each ordered pair of their node columns."""
    e = edges.where("src <> dst").select("graph", "src", "dst").distinct()
    for a, b in permutations(nodes, 2):
        mark = e.select("graph", F.col("src").alias(a), F.col("dst").alias(b), F.lit(1).alias(f"{a}_{b}"))
        sets = sets.join(mark, ["graph", a, b], "left").na.fill(0, [f"{a}_{b}"])
    return sets


def pattern_key(nodes: tuple[str, ...] = ("x", "y", "z")) -> Column:
    """The least arrangement of labels (x_outs, x_ins, ..) and matrix columns, as text."""
    forms = []
    for order in permutations(nodes):
        parts = [F.col(f"{n}_{c}").cast("string") for n in order for c in ("outs", "ins")] + [F.col(f"{a}_{b}").cast("string") for a, b in permutations(order, 2)]
        forms.append(F.concat_ws(",", *parts))
    return F.least(*forms)


def patterns(edges: DataFrame, graphs: int, max_degree: int = 16) -> DataFrame:
    """(graph, x, y, z, key) of connected induced patterns of seeds."""
    marked = labels(edges)
    chosen = seeds(marked, label_counts(marked), graphs, max_degree)
    sets = induced_matrix(triples(edges, chosen), edges)
    for n in "xyz":
        sets = sets.join(marked.select("graph", F.col("node").alias(n), F.col("outs").alias(f"{n}_outs"), F.col("ins").alias(f"{n}_ins")), ["graph", n])
    return sets.select("graph", "x", "y", "z", pattern_key().alias("key"))


def common_patterns(edges: DataFrame, graphs: int, max_degree: int = 16) -> DataFrame:
    """(key, counts..) of patterns that occur in all graphs; each needs a match in every other graph, which the key is."""
    per = patterns(edges, graphs, max_degree).groupBy("key", "graph").agg(F.count("*").alias("n"))
    return per.groupBy("key").agg(F.count("*").alias("graphs"), F.min("n").alias("least"), F.sum("n").alias("total")).where(F.col("graphs") == graphs).drop("graphs")


def neighbour_overlap(edges: DataFrame) -> DataFrame:
    """(graph, src, dst, shared, either): neighbours that an edge's ends share, and all they have; undirected, loops left out.

    Lists of neighbours meet at the edges: each is as long as its node's degree.
    """
    e = edges.where("src <> dst").select("graph", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = e.select("graph", "a", "b").unionByName(e.select("graph", F.col("b").alias("a"), F.col("a").alias("b")))
    lists = both.groupBy("graph", F.col("a").alias("node")).agg(F.collect_set("b").alias("near"))
    l, r = (lists.select("graph", F.col("node").alias(c), F.col("near").alias(f"near_{c}")) for c in "ab")
    met = e.join(l, ["graph", "a"]).join(r, ["graph", "b"])
    return met.select("graph", F.col("a").alias("src"), F.col("b").alias("dst"), F.size(F.array_intersect("near_a", "near_b")).alias("shared"), F.size(F.array_union("near_a", "near_b")).alias("either"))


def random_edges(spark, nodes: int, per_million: int, seed: int) -> DataFrame:
    """(src, dst) of a random digraph without loops: each pair is in with ``per_million`` chances, by the digest of seed and pair, so reruns agree.

    Pairs come from one range of numbers, dealt to all tasks.
    """
    pairs = spark.range(nodes * nodes).select(F.floor(F.col("id") / nodes).alias("src"), (F.col("id") % nodes).alias("dst")).where("src <> dst")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "src", "dst").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return pairs.where(draw % 1_000_000 < per_million)


def edgeless_match(sets: DataFrame) -> DataFrame:
    """(pos, graph, node): independent sets (graph, node) trimmed to their common size and laid side by side by id: a common subgraph without edges."""
    common = sets.groupBy("graph").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    return numbered(sets.select("graph", "node"), ["graph"], ["node"], "pos").join(F.broadcast(common)).where(F.col("pos") < F.col("least")).select("pos", "graph", "node")


def solved_components(jobs: DataFrame, edges: DataFrame, members: DataFrame, branches: int) -> DataFrame:
    """Incumbents of the ready jobs of component_pairs: each side's induced edges, from edges (graph, src, dst) and members (graph, component, node), become one row."""
    from skein.operators.common_subgraph import solve_jobs

    e = edges.where("src <> dst").select("graph", "src", "dst").distinct()
    sides = e.join(members.select("graph", "component", F.col("node").alias("src")), ["graph", "src"])
    lists = sides.groupBy("graph", "component").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    l, r = (lists.select(F.col("graph").alias(f"{s}_graph"), F.col("component").alias(f"{s}_component"), F.col("edges").alias(f"{s}_edges")) for s in ("left", "right"))
    met = jobs.where("status = 'ready'").join(l, ["left_graph", "left_component"]).join(r, ["right_graph", "right_component"])
    name = F.concat(F.col("left_graph"), F.lit("_wcc"), F.col("left_component"), F.lit("__"), F.col("right_graph"), F.lit("_wcc"), F.col("right_component"))
    return solve_jobs(met.select(name.alias("job"), "left_edges", "right_edges"), branches)


def component_pairs(sizes: DataFrame, least: int, gib: float) -> DataFrame:
    """Jobs between components (graph, component, size) of two graphs, both of ``least`` nodes or more; status tells which a dense solver would skip."""
    from skein.functions.text import dense_gib

    large = sizes.where(F.col("size") >= least)
    l, r = (large.select(*[F.col(c).alias(f"{s}_{c}") for c in ("graph", "component", "size")]) for s in ("left", "right"))
    met = l.join(r, F.col("left_graph") < F.col("right_graph"))
    need = dense_gib(F.col("left_size"), F.col("right_size"))
    return met.withColumn("gib", need).withColumn("status", F.when(need > gib, "skipped").otherwise("ready"))
