"""Mappings between graphs held against the graphs themselves, every mapping of a table at once.

A mapping table has a row for each place and side: (mapping, pos, side, graph, node). Edges are (graph, src, dst). Work is grouped by
(mapping, side); nothing is looped over on the driver, so thousands of mappings cost the joins of one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.components import components
from skein.operators.strong import strong_components
from skein.plans.staging import stage

KEYS = ["mapping", "side"]


def from_pairs(pairs: DataFrame) -> DataFrame:
    """The long form of rows (mapping, pos, left_graph, right_graph, l, r)."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_graph").alias("graph"), F.col(c).alias("node")) for s, c in (("left", "l"), ("right", "r"))])
    return pairs.select("mapping", "pos", F.explode(sides).alias("x")).select("mapping", "pos", "x.*")


def induced_by_mapping(corr: DataFrame, edges: DataFrame, loops: bool = True) -> DataFrame:
    """Distinct (mapping, side, src, dst) with both ends on a side; loops stay or go."""
    nodes = corr.select("mapping", "side", "graph", "node").distinct()
    e = edges.select("graph", "src", "dst").distinct()
    e = e if loops else e.where("src <> dst")
    met = e.join(nodes.withColumnRenamed("node", "src"), ["graph", "src"])
    return met.join(nodes.select(*KEYS, "graph", F.col("node").alias("dst")), [*KEYS, "graph", "dst"], "left_semi").select(*KEYS, "src", "dst")


def side_facts(corr: DataFrame, edges: DataFrame) -> DataFrame:
    """Per (mapping, side): graph, nodes (places), whether a node occurs twice, whether all are nodes of the graph."""
    known = edges.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("known", F.lit(True))
    met = corr.join(known, ["graph", "node"], "left")
    return met.groupBy(*KEYS).agg(
        F.max("graph").alias("graph"),
        F.count("*").alias("nodes"),
        (F.count_distinct("node") < F.count("*")).alias("duplicate"),
        F.bool_and(F.coalesce("known", F.lit(False))).alias("in_raw"),
    )


def shapes(corr: DataFrame, induced: DataFrame) -> DataFrame:
    """Per (mapping, side): number, largest and singletons of weak components, number and largest of strong ones.

    Components of all sides are found in one go over hashed keys of (mapping, side, node).
    """
    nodes = corr.select(*KEYS, "node").distinct()
    key = {c: F.xxhash64(*KEYS, c) for c in ("node", "src", "dst")}
    ends = induced.select(key["src"].alias("src"), key["dst"].alias("dst"))
    ends = stage(ends.unionByName(nodes.select(key["node"].alias("src"), key["node"].alias("dst"))), "shapes")
    named = nodes.withColumn("node", key["node"])

    def sizes(labels: DataFrame, prefix: str) -> DataFrame:
        by = named.join(labels, "node").groupBy(*KEYS, "component").agg(F.count("*").alias("n"))
        return by.groupBy(*KEYS).agg(F.count("*").alias(f"{prefix}_components"), F.max("n").alias(f"largest_{prefix}"), F.count_if(F.col("n") == 1).alias(f"{prefix}_singletons"))

    return sizes(components(ends), "weak").join(sizes(strong_components(ends), "strong"), KEYS)


def pair_differences(corr: DataFrame, induced: DataFrame) -> DataFrame:
    """Per mapping: edges of the left side that the right side lacks under the mapping, and edges it has besides.

    A left node that occurs again counts at its last place.
    """
    sides = corr.groupBy("mapping", "pos").agg(*[F.max(F.when(F.col("side") == s, F.col("node"))).alias(s[0]) for s in ("left", "right")])
    last = sides.groupBy("mapping", "l").agg(F.max_by("r", "pos").alias("r"))
    left = induced.where("side = 'left'")
    for end in ("src", "dst"):
        left = left.join(last.select("mapping", F.col("l").alias(end), F.col("r").alias(f"new_{end}")), ["mapping", end])
    left = left.select("mapping", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), F.lit(1).alias("left"), F.lit(0).alias("right"))
    both = left.unionByName(induced.where("side = 'right'").select("mapping", "src", "dst", F.lit(0).alias("left"), F.lit(1).alias("right")))
    per = both.groupBy("mapping", "src", "dst").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    return per.groupBy("mapping").agg(F.count_if(F.col("right") == 0).alias("missing"), F.count_if(F.col("left") == 0).alias("extra"))


def _side(facts: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return facts.where(F.col("side") == name).select("mapping", *[F.col(c).alias(f"{name}_{c}") for c in columns])


def verify_pairs(pairs: DataFrame, edges: DataFrame, loops: bool = True) -> DataFrame:
    """Per mapping of (mapping, pos, left_graph, right_graph, l, r): duplicates, nodes outside, induced edges of each side, differences, shapes, valid.

    A mapping is valid if no node occurs twice, all nodes are in their graph, and edges and non-edges agree.
    """
    corr = stage(from_pairs(pairs), "mapping")
    induced = stage(induced_by_mapping(corr, edges, loops), "induced")
    counts = induced.groupBy(*KEYS).agg(F.count("*").alias("edges"))
    facts = side_facts(corr, edges).join(counts, KEYS, "left").join(shapes(corr, induced), KEYS).na.fill(0, ["edges"])
    facts = stage(facts.withColumn("connected", F.col("weak_components") == 1), "facts")
    columns = ["graph", "nodes", "duplicate", "in_raw", "edges", "weak_components", "largest_weak", "strong_components", "largest_strong", "connected"]
    out = _side(facts, "left", columns).join(_side(facts, "right", columns).drop("right_nodes"), "mapping").withColumnRenamed("left_nodes", "nodes")
    out = out.join(pair_differences(corr, induced), "mapping", "left").na.fill(0, ["missing", "extra"])
    sound = ~F.col("left_duplicate") & ~F.col("right_duplicate") & F.col("left_in_raw") & F.col("right_in_raw")
    return out.withColumn("valid", sound & (F.col("missing") == 0) & (F.col("extra") == 0)).withColumn("edgeless", (F.col("left_edges") == 0) & (F.col("right_edges") == 0))


def density(edges: Column, nodes: Column) -> Column:
    return edges / F.greatest(F.lit(1), nodes * (nodes - 1))


def verify_samples(pairs: DataFrame, samples: DataFrame, raw: DataFrame) -> DataFrame:
    """Per mapping: valid in the samples, valid in the raw graphs, and whether the sample induces on each side what the raw graph does."""
    inner, outer = (verify_pairs(pairs, e) for e in (samples, raw))
    corr = from_pairs(pairs)
    marked = induced_by_mapping(corr, samples).withColumn("s", F.lit(1)).withColumn("r", F.lit(0)).unionByName(induced_by_mapping(corr, raw).withColumn("s", F.lit(0)).withColumn("r", F.lit(1)))
    same = marked.groupBy(*KEYS, "src", "dst").agg(F.max("s").alias("s"), F.max("r").alias("r")).groupBy("mapping").agg(*[(F.count_if((F.col("side") == x) & (F.col("s") != F.col("r"))) == 0).alias(f"{x}_sample_is_raw") for x in ("left", "right")])
    a = inner.select("mapping", "nodes", *[F.col(c).alias(f"sample_{c}") for c in ("left_edges", "right_edges", "missing", "extra", "valid")], density(F.col("left_edges"), F.col("nodes")).alias("left_density"), density(F.col("right_edges"), F.col("nodes")).alias("right_density"))
    b = outer.select("mapping", *[F.col(c).alias(f"raw_{c}") for c in ("left_edges", "right_edges", "missing", "extra", "valid")])
    out = a.join(b, "mapping").join(same, "mapping", "left").na.fill(True, ["left_sample_is_raw", "right_sample_is_raw"])
    return out.withColumn("passed", F.col("sample_valid") & F.col("raw_valid") & F.col("left_sample_is_raw") & F.col("right_sample_is_raw"))


def verify_many(corr: DataFrame, edges: DataFrame, sides: list[str]) -> DataFrame:
    """Per mapping between several graphs, loops left out: facts and shapes of each side, ``iso_x_y`` for every two sides, and isomorphic.

    Edges are compared as places of the mapping; a node that occurs again counts at its last place.
    """
    corr = stage(corr, "mapping")
    induced = stage(induced_by_mapping(corr, edges, False), "induced")
    last = corr.groupBy(*KEYS, "node").agg(F.max("pos").alias("pos"))
    placed = induced
    for end in ("src", "dst"):
        placed = placed.join(last.select(*KEYS, F.col("node").alias(end), F.col("pos").alias(f"{end}_pos")), [*KEYS, end])
    per = placed.groupBy("mapping", "src_pos", "dst_pos").agg(*[F.bool_or(F.col("side") == s).alias(s) for s in sides])
    pairs = list(combinations(sides, 2))
    same = per.groupBy("mapping").agg(*[F.count_if(s).alias(f"{s}_edges") for s in sides], *[(F.count_if(F.col(x) != F.col(y)) == 0).alias(f"iso_{x}_{y}") for x, y in pairs])
    facts = stage(side_facts(corr, edges).join(shapes(corr, induced), KEYS), "facts")
    out = None
    columns = ["nodes", "duplicate", "in_raw", "weak_components", "largest_weak", "weak_singletons", "strong_components", "largest_strong"]
    for s in sides:
        side = _side(facts, s, columns).withColumnRenamed(f"{s}_nodes", "nodes")
        out = side if out is None else out.join(side.drop("nodes"), "mapping")
    out = out.join(same, "mapping", "left").na.fill(0, [f"{s}_edges" for s in sides]).na.fill(True, [f"iso_{x}_{y}" for x, y in pairs])
    fine = F.lit(True)
    for s in sides:
        fine = fine & ~F.col(f"{s}_duplicate") & F.col(f"{s}_in_raw")
    for x, y in pairs:
        fine = fine & F.col(f"iso_{x}_{y}")
    return out.withColumn("isomorphic", fine)


def resolved(pairs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of places (mapping, pos, left_graph, right_graph, li, ri) as nodes by (graph, idx, node), and per mapping its pairs and those out of range."""
    met = pairs
    for side, at, name in (("left", "li", "l"), ("right", "ri", "r")):
        met = met.join(index.select(F.col("graph").alias(f"{side}_graph"), F.col("idx").alias(at), F.col("node").alias(name)), [f"{side}_graph", at], "left")
    out = F.col("l").isNull() | F.col("r").isNull()
    counts = met.groupBy("mapping").agg(F.count("*").alias("pairs"), F.count_if(out).alias("out_of_range"))
    return met.where(~out).select("mapping", "pos", "left_graph", "right_graph", "l", "r"), counts


def revalidate(rows: DataFrame, pairs: DataFrame, index: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored summary rows (mapping, returncode, valid_solution, stdout_log, sample_id, ..) with what their pairs show now, loops left out.

    Only rows with a log and a return code of 0 or skipped_existing are looked at. A row is valid if the solver said so and the
    check agrees; then mapped_pairs is restored, else it is 0 and the mapping is blank.
    """
    from skein.functions.text import sample_id

    chosen = rows.where((F.coalesce("stdout_log", F.lit("")) != "") & F.col("returncode").isin("0", "skipped_existing"))
    nodes, counts = resolved(pairs.join(chosen.select("mapping"), "mapping", "left_semi"), index)
    seen = verify_pairs(nodes, edges, loops=False).select("mapping", "left_duplicate", "right_duplicate", "left_edges", "right_edges", "missing", "extra", "valid")
    found = counts.join(seen, "mapping", "left").withColumn("external", F.coalesce((F.col("out_of_range") == 0) & F.col("valid"), F.lit(False))).drop("valid")
    out = chosen.join(found, "mapping", "left")
    valid = (F.col("valid_solution") == "1") & F.coalesce("external", F.lit(False))
    return out.withColumns({"sample_id": sample_id(F.col("sample_id"), F.col("stdout_log")), "is_valid": valid, "mapped_pairs": F.when(valid, F.col("pairs")).otherwise(F.lit(0)), "edges": F.least("left_edges", "right_edges")})
