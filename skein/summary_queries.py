"""Registered queries on summaries: components, types, modules, labels, patterns, jobs, text and number functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import hashing
from skein.functions import text as t
from skein.operators import graph as g
from skein.operators import patterns as pt
from skein.operators import summary as su
from skein.plans.numbering import numbered
from skein.plans.staging import stage
from skein.queries import _WCC, _nodeset, query, type_outdegree_stats, wcc_assign
from skein.sinks import tables as out
from skein.sources.edges import annotations, edges_of, succession
from skein.sources.files import annotated
from skein.sources.solver_log import log_blocks, named_parts, summary_values
from skein.structure_queries import _FEATURES, _SCC, node_roles, scc_assign


def _wrap(ctes: str, body: str) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {ctes}\n{body})"


# --- components ---

_ASSIGN = """SELECT node AS node_id, component AS component_id, size AS component_size, rank AS component_size_rank FROM {of} JOIN (SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS rank FROM {of} GROUP BY component) USING (component)"""
_SUM = """SELECT sum(size)::BIGINT AS nodes, count(*) AS components, count_if(size = 1)::BIGINT AS singletons, count_if(size > 1)::BIGINT AS nontrivial, max(size) AS largest, max(size) / sum(size) AS fraction, (SELECT string_agg(size::VARCHAR, ';' ORDER BY size DESC) FROM (SELECT count(*) AS size FROM {of} GROUP BY component ORDER BY size DESC LIMIT 10)) AS top10,
(SELECT count(*) FROM ea) AS edges FROM (SELECT count(*) AS size FROM {of} GROUP BY component)"""


@query(_wrap(_WCC, _ASSIGN.format(of="wcc")))
def wcc_assignments(spark, d):
    return out.assignments(stage(wcc_assign(spark, d), "wcc"))


@query(_wrap(_SCC, _ASSIGN.format(of="scc")))
def scc_assignments(spark, d):
    return out.assignments(stage(scc_assign(spark, d), "scc"))


@query(_wrap(_WCC, _SUM.format(of="wcc")))
def wcc_component_summary(spark, d):
    return out.component_summary(stage(wcc_assign(spark, d), "wcc"), edges_of(spark, d, "A"))


@query(_wrap(_SCC, _SUM.format(of="scc")))
def scc_component_summary(spark, d):
    return out.component_summary(stage(scc_assign(spark, d), "scc"), edges_of(spark, d, "A"))


_WCC3 = """walk(graph, a, b) AS (SELECT graph, node, node FROM nodes UNION SELECT w.graph, w.a, e.b FROM walk w JOIN (SELECT graph, src AS a, dst AS b FROM edges UNION SELECT graph, dst, src FROM edges) e ON e.graph = w.graph AND e.a = w.b),
wcc3 AS MATERIALIZED (SELECT graph, component, count(*) AS size FROM (SELECT graph, a, min(b) AS component FROM walk GROUP BY ALL) GROUP BY ALL)"""


def _wcc3(spark, d) -> DataFrame:
    """(graph, component, size) of all three graphs at once: their nodes are told apart by a number a graph."""
    from skein.operators.components import components

    e = edges_of(spark, d)
    at = F.ascii("graph").cast("long")
    keyed = e.select((F.col("src") * 256 + at).alias("src"), (F.col("dst") * 256 + at).alias("dst"))
    found = components(keyed).groupBy("component").agg(F.count("*").alias("size"))
    return found.select(F.chr(F.col("component") % 256).alias("graph"), F.floor(F.col("component") / 256).alias("component"), "size")


@query(_wrap(_WCC3, "SELECT graph, component, size FROM wcc3"))
def wcc_of_each_graph(spark, d):
    return _wcc3(spark, d)


@query(_wrap(_WCC3, """SELECT l.graph AS left_graph, l.component AS left_component, l.size AS left_size, r.graph AS right_graph, r.component AS right_component, r.size AS right_size,
8.0::DOUBLE * (l.size * l.size + r.size * r.size) / 1073741824 AS gib, CASE WHEN 8.0::DOUBLE * (l.size * l.size + r.size * r.size) / 1073741824 > 0.01 THEN 'skipped' ELSE 'ready' END AS status FROM wcc3 l JOIN wcc3 r ON l.graph < r.graph AND l.size >= 2 AND r.size >= 2"""))
def wcc_pair_jobs(spark, d):
    """Jobs between components of two graphs, with the memory a dense solver would need and whether it is too much."""
    return pt.component_pairs(stage(_wcc3(spark, d), "wcc"), 2, 0.01)


# --- types, roles, values ---


@query("""SELECT *, row_number() OVER (ORDER BY mean DESC, cells DESC, primary_type) AS place FROM (SELECT p_type AS primary_type, count(*) AS cells, round_even(avg(od), 4) AS mean, median(od) AS median, max(od) AS max, sum(od)::BIGINT AS sum
FROM (SELECT p.p_type, (SELECT count(*) FROM ea WHERE ea.src = p.p_partkey) AS od FROM part p) GROUP BY p_type) WHERE cells >= 10""")
def type_outdegree_report(spark, d):
    """Types with ten cells or more, by mean, cells (both falling) and name."""
    rows = type_outdegree_stats(spark, d).where("cells >= 10").withColumns({"a": -F.col("mean"), "b": -F.col("cells")})
    return numbered(rows, [], ["a", "b", "primary_type"], "place", 1).drop("a", "b")


@query(_wrap(_FEATURES, """, best AS (SELECT label FROM typed GROUP BY label ORDER BY count(*) DESC, label LIMIT 5) SELECT role, CASE WHEN label IN (SELECT label FROM best) THEN label ELSE 'other' END AS label, count(*) AS n FROM typed GROUP BY ALL""".replace(", best", ", best", 1)).replace("\n, best", ",\nbest"))
def role_top_and_other(spark, d):
    typed = node_roles(spark, d).join(annotations(spark, d), "node").select("role", t.type_or_untyped(F.col("primary_type")).alias("label"))
    counts = stage(typed.groupBy("role", "label").agg(F.count("*").alias("n")), "counts")
    return su.top_and_other(counts, ["role"], 5)


_MESSY = "SELECT p_partkey::BIGINT AS node, p_type, CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL ELSE p_brand END AS label, CASE p_partkey % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN 'nan' ELSE p_size::VARCHAR END AS size_text FROM part"


def _messy(spark, d) -> DataFrame:
    a, k = annotations(spark, d), F.col("node")
    label = F.when(k % 5 == 0, " ").when(k % 5 == 1, "NaN").when(k % 5 == 2, F.lit(None)).otherwise(F.col("sub_class"))
    size = F.when(k % 7 == 0, "n/a").when(k % 7 == 1, "nan").otherwise(F.col("size").cast("string"))
    return a.select("node", "primary_type", label.alias("label"), size.alias("size_text"))


@query(f"SELECT label, count(*) AS n FROM ({_MESSY}) WHERE label IS NOT NULL AND trim(label) <> '' AND lower(label) <> 'nan' GROUP BY label")
def value_counts_clean(spark, d):
    return su.value_counts(_messy(spark, d), "label")


@query(f"""SELECT p_type AS primary_type, string_agg(label || ':' || n, '; ' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, label) AS r FROM (SELECT p_type, label, count(*) AS n FROM ({_MESSY})
WHERE label IS NOT NULL AND trim(label) <> '' AND lower(label) <> 'nan' GROUP BY ALL)) WHERE r <= 8 GROUP BY p_type""")
def counter_text(spark, d):
    return su.top_text(su.value_counts(_messy(spark, d), "label", "primary_type"), ["primary_type"])


@query(f"SELECT p_type AS primary_type, 'size_text' AS metric, count(x) AS n, min(x) AS min, max(x) AS max, avg(x) AS mean, median(x) AS median FROM (SELECT p_type, CASE WHEN size_text NOT IN ('n/a', 'nan') THEN size_text::DOUBLE END AS x FROM ({_MESSY})) GROUP BY p_type")
def coerced_stats(spark, d):
    """Statistics over what is a number; other text doesn't count."""
    return su.metric_stats(_messy(spark, d), ["size_text"], "primary_type")


@query(f"SELECT node, coalesce(nullif(trim(CASE WHEN lower(label) = 'nan' THEN '' ELSE label END), ''), 'untyped') AS label, CASE WHEN size_text NOT IN ('n/a', 'nan') THEN size_text::DOUBLE END AS number, size_text NOT IN ('n/a', 'nan') AS is_number FROM ({_MESSY})")
def numeric_guard(spark, d):
    rows = _messy(spark, d)
    n = su.number(F.col("size_text"))
    return rows.select("node", t.type_or_untyped(F.col("label")).alias("label"), n.alias("number"), n.isNotNull().alias("is_number"))


# --- modules ---

_MODULES = "mods AS MATERIALIZED (SELECT graph, node, p_size % 4 AS module FROM nodes JOIN part ON p_partkey = node WHERE p_size <= 20)"


def _modules(spark, d) -> DataFrame:
    rows = g.nodes_of(edges_of(spark, d), "graph").join(annotations(spark, d), "node").where("size <= 20")
    return rows.select((F.col("size") % 4).alias("module"), "graph", "node")


def _top(rows: str, label: str) -> str:
    return f"coalesce((SELECT string_agg(label || ':' || n, '; ' ORDER BY n DESC, label) FROM (SELECT {label} AS label, count(*) AS n FROM {rows} GROUP BY 1 ORDER BY n DESC, label LIMIT 8)), '')"


_CHAR = f"""{_MODULES}, mg AS (SELECT DISTINCT module, graph FROM mods), marked AS MATERIALIZED (SELECT mg.module, r.*, EXISTS (SELECT * FROM mods m WHERE m.module = mg.module AND m.graph = r.graph AND m.node = r.src) AS s, EXISTS (SELECT * FROM mods m WHERE m.module = mg.module AND m.graph = r.graph AND m.node = r.dst) AS t FROM rows1 r JOIN mg USING (graph)),
way AS MATERIALIZED (SELECT *, CASE WHEN s AND t THEN 'internal' WHEN s THEN 'outgoing' ELSE 'incoming' END AS direction FROM marked WHERE s OR t),
md AS MATERIALIZED (SELECT module, graph, node, p_brand, p_type, p_partkey IS NOT NULL AS hit FROM mods LEFT JOIN part ON p_partkey = node AND p_size % 3 <> 0)"""
_CHAR_SQL = """SELECT mg.module, mg.graph, (SELECT count(DISTINCT node) FROM mods m WHERE m.module = mg.module AND m.graph = mg.graph) AS nodes, (SELECT count(*) FROM md m WHERE m.module = mg.module AND m.graph = mg.graph AND hit) AS found,
(SELECT count(*) FROM md m WHERE m.module = mg.module AND m.graph = mg.graph AND hit) / (SELECT count(DISTINCT node) FROM mods m WHERE m.module = mg.module AND m.graph = mg.graph) AS coverage""" + "".join(
    f", (SELECT count(*) FROM way w WHERE w.module = mg.module AND w.graph = mg.graph AND direction = '{w}') AS {w}_rows, (SELECT coalesce(sum(syn_count), 0)::BIGINT FROM way w WHERE w.module = mg.module AND w.graph = mg.graph AND direction = '{w}') AS {w}_syn" for w in ("internal", "outgoing", "incoming")) + "".join(
    f", {_top(f'(SELECT * FROM way w WHERE w.module = mg.module AND w.graph = mg.graph AND direction = {chr(39)}{w}{chr(39)})', c)} AS top_{w}_{n}" for w, c, n in (("internal", "neuropil", "neuropil"), ("internal", "graph", "nt_type"), ("outgoing", "neuropil", "neuropil"), ("incoming", "neuropil", "neuropil"))) + "".join(
    f", {_top('(SELECT * FROM md m WHERE m.module = mg.module AND m.graph = mg.graph AND hit)', c)} AS top_{n}" for c, n in (("p_type", "primary_type"), ("p_brand", "sub_class"))) + " FROM mg"


@query(_wrap(_CHAR, _CHAR_SQL))
def module_characterisation(spark, d):
    """A row a module and graph: coverage by annotations, rows and weights inside, out and in, top values of facets and fields."""
    known = annotations(spark, d).where("size % 3 <> 0").select("node", "primary_type", "sub_class")
    return su.characterised(stage(_modules(spark, d), "modules"), stage(succession(spark, d), "rows"), known, ["primary_type", "sub_class"])


@query(_wrap(_CHAR, f"SELECT 'run' AS run_name, graph, count(*) AS modules, min(nodes) AS nodes_min, median(nodes) AS nodes_median, max(nodes) AS nodes_max, median(internal_rows) AS internal_rows_median, median(internal_syn) AS internal_syn_median FROM ({_CHAR_SQL}) GROUP BY graph"))
def module_runs(spark, d):
    rows = module_characterisation(spark, d).withColumn("run_name", F.lit("run"))
    return rows.groupBy("run_name", "graph").agg(F.count("*").alias("modules"), F.min("nodes").alias("nodes_min"), F.median("nodes").alias("nodes_median"), F.max("nodes").alias("nodes_max"), F.median("internal_rows").alias("internal_rows_median"), F.median("internal_syn").alias("internal_syn_median"))


@query(f"SELECT * FROM (WITH {_MODULES} SELECT module, graph, count(*) AS nodes, count_if(p_size % 3 <> 0)::BIGINT AS hits, count_if(p_size % 3 <> 0) / greatest(1, count(*)) AS coverage FROM mods JOIN part ON p_partkey = node GROUP BY ALL)")
def metadata_coverage(spark, d):
    known = annotations(spark, d).where("size % 3 <> 0").select("node", F.lit(1).alias("hit"))
    per = _modules(spark, d).join(known, "node", "left").groupBy("module", "graph").agg(F.count("*").alias("nodes"), F.count("hit").alias("hits"))
    return per.withColumn("coverage", F.col("hits") / F.greatest(F.lit(1), "nodes"))


@query("""SELECT n.node, a.p_type AS primary_type, b.p_brand AS sub_class, c.p_size AS size FROM (SELECT node FROM nodes WHERE graph = 'A') n LEFT JOIN (SELECT * FROM part WHERE p_size % 2 = 0) a ON a.p_partkey = n.node LEFT JOIN (SELECT * FROM part WHERE p_size % 3 = 0) b ON b.p_partkey = n.node LEFT JOIN part c ON c.p_partkey = n.node""")
def annotated_nodes(spark, d):
    """Nodes with three annotation tables, one left join after the other."""
    a = annotations(spark, d)
    tables = (a.where("size % 2 = 0").select("node", "primary_type"), a.where("size % 3 = 0").select("node", "sub_class"), a.select("node", "size"))
    return annotated(g.nodes_of(edges_of(spark, d, "A")), *tables)


# --- labels and patterns ---

_LAB = "lab AS MATERIALIZED (SELECT graph, node, count(DISTINCT o) AS outs, count(DISTINCT i) AS ins FROM (SELECT graph, src AS node, dst AS o, NULL AS i FROM edges UNION ALL SELECT graph, dst, NULL, src FROM edges) GROUP BY ALL), lc AS MATERIALIZED (SELECT outs, ins, count(*) AS graphs, min(n) AS least FROM (SELECT graph, outs, ins, count(*) AS n FROM lab GROUP BY ALL) GROUP BY ALL)"


@query(_wrap(_LAB, "SELECT outs, ins, graphs, least FROM lc"))
def label_rarity(spark, d):
    return pt.label_counts(pt.labels(edges_of(spark, d)))


@query(_wrap(_LAB, """SELECT pattern, bool_and(coalesce(graphs, 0) = 3 AND coalesce(least, 0) >= needed) AS feasible FROM (SELECT node % 50 AS pattern, outs, ins, count(*) AS needed FROM lab WHERE graph = 'A' AND node % 100 < 50 GROUP BY ALL) LEFT JOIN lc USING (outs, ins) GROUP BY pattern"""))
def label_feasibility(spark, d):
    """Patterns (here sets of nodes of A) whose labels all graphs have often enough."""
    marked = stage(pt.labels(edges_of(spark, d)), "labels")
    needs = marked.where("graph = 'A' and node % 100 < 50").groupBy((F.col("node") % 50).alias("pattern"), "outs", "ins").agg(F.count("*").alias("needed"))
    return pt.feasible(needs, pt.label_counts(marked), 3)


@query("SELECT graph, count(*) AS nodes FROM nodes GROUP BY graph ORDER BY nodes, graph LIMIT 1")
def smallest_graph(spark, d):
    return pt.smallest_graph(g.nodes_of(edges_of(spark, d), "graph"))


@query(_wrap(_LAB, """SELECT graph, node, rarity, degree, row_number() OVER (PARTITION BY graph ORDER BY rarity, degree, node) - 1 AS turn FROM (SELECT l.graph, l.node, (SELECT count(*) FROM lab m WHERE m.graph = l.graph AND m.outs = l.outs AND m.ins = l.ins) AS rarity, l.outs + l.ins AS degree FROM lab l JOIN lc ON lc.outs = l.outs AND lc.ins = l.ins AND lc.graphs = 3) WHERE degree <= 16"""))
def seed_order(spark, d):
    """Nodes in the order in which pattern search tries them: rarity of the label, degree, id."""
    marked = stage(pt.labels(edges_of(spark, d)), "labels")
    return numbered(pt.seeds(marked, pt.label_counts(marked), 3, 16), ["graph"], ["rarity", "degree", "node"], "turn")


_TRI = f"""{_LAB}, ok AS MATERIALIZED (SELECT graph, node, lab.outs, lab.ins FROM lab JOIN lc ON lc.outs = lab.outs AND lc.ins = lab.ins WHERE lc.graphs = 3 AND lab.outs + lab.ins <= 16),
un AS MATERIALIZED (SELECT DISTINCT graph, a, b FROM (SELECT graph, src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT graph, dst, src FROM edges WHERE src <> dst) e WHERE (graph, a) IN (SELECT graph, node FROM ok) AND (graph, b) IN (SELECT graph, node FROM ok)),
tri AS MATERIALIZED (SELECT DISTINCT graph, list_sort([p.a, p.b, q.b]) AS t FROM un p JOIN un q USING (graph, a) WHERE p.b < q.b),
bits AS (SELECT graph, t, list_transform(t, lambda v: v) AS v, {", ".join(f"(graph, t[{i}], t[{j}]) IN (SELECT graph, src, dst FROM edges) AS e{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i != j)} FROM tri),
full_bits AS (SELECT b.graph, t, {", ".join(f"x{i}.outs AS o{i}, x{i}.ins AS i{i}" for i in (1, 2, 3))}, {", ".join(f"e{i}{j}::INT AS e{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i != j)} FROM bits b JOIN lab x1 ON x1.graph = b.graph AND x1.node = t[1] JOIN lab x2 ON x2.graph = b.graph AND x2.node = t[2] JOIN lab x3 ON x3.graph = b.graph AND x3.node = t[3]),
keyed AS (SELECT graph, t, least({", ".join("concat_ws(',', " + ", ".join([f"o{n}, i{n}" for n in p] + [f"e{a}{b}" for a, b in ((p[0], p[1]), (p[0], p[2]), (p[1], p[0]), (p[1], p[2]), (p[2], p[0]), (p[2], p[1]))]) + ")" for p in ((1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)))}) AS key FROM full_bits)"""


@query(_wrap(_TRI, "SELECT key, min(n) AS least, sum(n)::BIGINT AS total FROM (SELECT key, graph, count(*) AS n FROM keyed GROUP BY ALL) GROUP BY key HAVING count(*) = 3"))
def common_patterns_k3(spark, d):
    """Connected patterns of three nodes that all graphs have, induced and with equal labels."""
    return pt.common_patterns(stage(edges_of(spark, d), "edges"), 3)


@query("""SELECT graph, src, dst, count_if(a AND b)::INT AS shared, count(*)::INT AS either FROM (SELECT e.graph, e.src, e.dst, u.o, bool_or(u.n = e.src) AS a, bool_or(u.n = e.dst) AS b FROM (SELECT DISTINCT graph, least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src <> dst) e
JOIN (SELECT graph, src AS n, dst AS o FROM edges WHERE src <> dst UNION SELECT graph, dst, src FROM edges WHERE src <> dst) u ON u.graph = e.graph AND u.n IN (e.src, e.dst) GROUP BY ALL) GROUP BY graph, src, dst""")
def neighbour_overlap(spark, d):
    return pt.neighbour_overlap(edges_of(spark, d))


@query("SELECT i AS src, j AS dst FROM range(60) a(i), range(60) b(j) WHERE i <> j AND ('0x' || substr(md5('7:' || i || ':' || j), 1, 8))::BIGINT % 1000000 < 80000")
def random_digraph(spark, d):
    """A G(60, 0.08) digraph that reruns draw alike."""
    return pt.random_edges(spark, 60, 80_000, 7)


@query("SELECT src, dst, count(*) AS paths FROM (SELECT a.src, b.dst FROM ea a JOIN ea b ON a.dst = b.src WHERE a.src <> b.dst) GROUP BY ALL HAVING count(*) > 1")
def double_paths(spark, d):
    """Pairs that two or more paths of two edges lead between."""
    e = edges_of(spark, d, "A")
    met = e.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst")
    return met.groupBy("src", "dst").agg(F.count("*").alias("paths")).where("paths > 1")


# --- jobs, runs, distributions ---


@query("SELECT 'A-N-R' AS triplet, size, l.graph AS left_graph, r.graph AS right_graph, row_number() OVER (ORDER BY size, l.graph, r.graph) - 1 AS job_index FROM (SELECT DISTINCT graph FROM edges) l, (SELECT DISTINCT graph FROM edges) r, (SELECT unnest([1000, 2000, 500]) AS size) s WHERE l.graph < r.graph")
def job_order(spark, d):
    """Pair jobs of each size in their final order: by size as a number, then names."""
    names = edges_of(spark, d).select("graph").distinct()
    sizes = spark.createDataFrame([(1000,), (2000,), (500,)], "size int")
    met = names.withColumnRenamed("graph", "left_graph").join(names.withColumnRenamed("graph", "right_graph"), F.col("left_graph") < F.col("right_graph")).join(F.broadcast(sizes))
    return numbered(met.withColumn("triplet", F.lit("A-N-R")), ["triplet"], ["size", "left_graph", "right_graph"], "job_index")


def _runs(spark, d) -> list[tuple[str, DataFrame]]:
    e = edges_of(spark, d)
    per = lambda x: e.where(F.col("graph") == x).groupBy("src").agg(F.count("*").alias("threeway_nodes"), F.min("dst").alias("largest_weak_component"))
    return [("first", per("A").withColumn("note", F.lit("x"))), ("second", per("N"))]


@query("SELECT 'first' AS run_name, src, count(*) AS threeway_nodes, min(dst) AS largest_weak_component, 'x' AS note FROM edges WHERE graph = 'A' GROUP BY src UNION ALL SELECT 'second', src, count(*), min(dst), NULL FROM edges WHERE graph = 'N' GROUP BY src")
def joined_runs(spark, d):
    return out.joined_runs(_runs(spark, d))


@query("""SELECT p_partkey::BIGINT AS node, CASE WHEN p_size > 5 THEN p_partkey::DOUBLE / p_size END AS largest_weak_ratio, CASE WHEN p_size > 5 AND p_partkey % 2 = 0 THEN p_partkey * 1.0::DOUBLE / p_size END AS largest_strong_ratio, CASE WHEN p_size > 5 THEN 2.0::DOUBLE * p_partkey / p_size END AS isolated_weak_ratio FROM part""")
def run_ratios(spark, d):
    """Ratios of columns that hold text: what is no number gives null, and so does a size of 0."""
    a = annotations(spark, d)
    size, k = F.col("size"), F.col("node")
    rows = a.select("node", F.when(size > 5, size.cast("string")).when(size > 2, "0").otherwise("?").alias("threeway_nodes"), k.cast("string").alias("largest_weak_component"), F.when(k % 2 == 0, k.cast("string")).otherwise("").alias("largest_strong_component"), (k * 2).alias("isolated_nodes_weak"))
    return out.with_ratios(rows).select("node", "largest_weak_ratio", "largest_strong_ratio", "isolated_weak_ratio")


_DEG = "deg AS (SELECT graph, node, count(*) AS degree FROM (SELECT graph, src AS node FROM edges UNION ALL SELECT graph, dst FROM edges) GROUP BY ALL)"


@query(_wrap(_DEG, "SELECT graph, CASE WHEN hi = lo THEN 0 ELSE least(floor((degree - lo) * 12 / (hi - lo)), 11) END::INT AS bin, count(*) AS n FROM deg, (SELECT min(degree) AS lo, max(degree) AS hi FROM deg) GROUP BY ALL"))
def degree_histogram(spark, d):
    return su.histogram(g.total_degree(edges_of(spark, d), "graph"), "degree", 12, "graph")


@query(_wrap(_DEG, "SELECT graph, " + ", ".join(f"quantile_cont(degree, {i / 4})::DOUBLE AS q{i}" for i in range(5)) + " FROM deg GROUP BY graph"))
def degree_quartiles(spark, d):
    return su.quartiles(g.total_degree(edges_of(spark, d), "graph"), "degree", "graph")


@query("""SELECT n.node AS id, p_type AS primary_type, (SELECT count(*) FROM ea WHERE src = n.node AND dst <> n.node) AS out_degree, (SELECT count(*) FROM ea WHERE dst = n.node AND src <> n.node) AS in_degree FROM (SELECT node FROM nodes WHERE graph = 'A') n LEFT JOIN part ON p_partkey = n.node""")
def network_nodes(spark, d):
    return out.network(edges_of(spark, d, "A"), annotations(spark, d).select("node", "primary_type"))[0]


@query("SELECT p_size AS size, m.node IS NOT NULL AS wanted, count(*) AS n FROM part LEFT JOIN nodeset m ON m.node = p_partkey GROUP BY ALL")
def reindexed(spark, d):
    """Every key of a table, with what another one has for it."""
    have = _nodeset(spark, d).withColumn("w", F.lit(True))
    return annotations(spark, d).join(have, "node", "left").groupBy("size", F.coalesce("w", F.lit(False)).alias("wanted")).agg(F.count("*").alias("n"))


# --- text and numbers ---

_MASK = "18446744073709551615"


def _times(a: str, b: int) -> str:
    """a * b modulo 2**64 in 128-bit integers, by halves of b."""
    return f"((({a}) * {b & 0xFFFFFFFF} + ((({a}) * {b >> 32}) % 4294967296) * 4294967296) % 18446744073709551616::HUGEINT)"


@query(f"""SELECT node, CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END::BIGINT AS mixed FROM (SELECT node, xor(c::UBIGINT, (c // 2147483648)::UBIGINT)::HUGEINT AS h FROM (SELECT node, {_times("b", 0x94D049BB133111EB)} AS c FROM (SELECT node, xor(a::UBIGINT, (a // 134217728)::UBIGINT)::HUGEINT AS b
FROM (SELECT node, {_times("z", 0xBF58476D1CE4E5B9)} AS a FROM (SELECT node, xor(y::UBIGINT, (y // 1073741824)::UBIGINT)::HUGEINT AS z FROM (SELECT p_partkey::BIGINT AS node, (p_partkey::HUGEINT + 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT AS y FROM part))))))""")
def splitmix(spark, d):
    return annotations(spark, d).select("node", hashing.splitmix64(F.col("node")).alias("mixed"))


@query("""SELECT node, CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END::BIGINT AS hash FROM (SELECT p_partkey::BIGINT AS node,
list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(range(0, 8), lambda i: ((p_partkey::BIGINT >> (8 * i)::INT) & 255)::HUGEINT), list_transform(range(0, 8), lambda i: ((p_size::BIGINT >> (8 * i)::INT) & 255)::HUGEINT)),
lambda a, b: (xor(a::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM part)""")
def fnv_hash(spark, d):
    return annotations(spark, d).select("node", hashing.fnv1a(F.array("node", F.col("size").cast("long"))).alias("hash"))


@query("SELECT p_partkey::BIGINT AS node, printf('%.6f', CASE WHEN p_partkey = 0 THEN 0 ELSE p_size::DOUBLE / p_partkey END) AS ratio, CASE WHEN p_size % 5 > 0 THEN p_partkey::DOUBLE / (p_size % 5) ELSE 'inf'::DOUBLE END AS fold, round(pow(p_size::DOUBLE, 0.35), 9) AS scaled, 8.0::DOUBLE * (p_size * p_size + p_partkey * p_partkey) / 1073741824 AS gib FROM part")
def number_forms(spark, d):
    """Fixed ratios, folds that may be infinite, scaled sizes, dense memory."""
    n, s = F.col("node"), F.col("size").cast("long")
    return annotations(spark, d).select("node", t.fixed_ratio(s.cast("double"), n).alias("ratio"), t.fold(n.cast("double"), s % 5).alias("fold"), F.round(F.pow(s, F.lit(0.35)), 9).alias("scaled"), t.dense_gib(s, n).alias("gib"))


@query("SELECT p_type AS primary_type, string_agg(p_partkey::VARCHAR, ' ' ORDER BY p_partkey) AS members, count(*) AS n, sum(p_partkey)::BIGINT AS total, p_type || '--' || max(p_size) || '|' || min(p_size) AS tag FROM part GROUP BY p_type")
def member_text(spark, d):
    """Ids joined by spaces and read back; names joined by other signs."""
    rows = annotations(spark, d).groupBy("primary_type").agg(t.ids_text(F.array_sort(F.collect_list("node"))).alias("members"), F.max("size").alias("hi"), F.min("size").alias("lo"))
    ids = t.ids_of(F.col("members"))
    tag = F.concat(F.concat_ws("--", "primary_type", "hi"), F.lit("|"), F.col("lo"))
    return rows.select("primary_type", "members", F.size(ids).cast("long").alias("n"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), tag.alias("tag"))


#: A solver's output: two blocks, noise before, between and after.
_LOG = ["banner", "M 9 9", "12, 3, 0, 1.5, 2, 1, 0, 0, 7, 1", "M 0 5", "M 1 4", "note", "M 2 3", "15, 4", "20, 5, 0, 1.5, 2, 1, 0, 0, 7, 1, x", "M 0 1", "end"]


@query("SELECT * FROM (VALUES ('j', 1::BIGINT, '12', 10, 3, 0::BIGINT, 2::BIGINT), ('j', 2::BIGINT, '20', 11, 1, 0::BIGINT, 0::BIGINT)) t(job, block, first, fields, pairs, l0, l_last)")
def solver_blocks(spark, d):
    lines = spark.createDataFrame([("j", i, x) for i, x in enumerate(_LOG)], "job string, line_no long, value string")
    rows = log_blocks(lines, "job")
    return rows.select("job", "block", F.col("metrics")[0].alias("first"), F.size("metrics").alias("fields"), F.size("pairs").alias("pairs"), F.col("pairs")[0]["l"].alias("l0"), F.element_at("pairs", -1)["l"].alias("l_last"))


@query("""SELECT p_partkey::BIGINT AS node, p_type AS left_graph, p_brand AS right_graph, p_size::VARCHAR AS size, 's' || p_partkey AS sample, 's' || p_partkey AS from_log FROM part""")
def filename_parse(spark, d):
    """Names "<left>__<right>.n<size>.<id>.mcs_nodes.csv" and logs, taken apart."""
    a = annotations(spark, d)
    name = F.concat("primary_type", F.lit("__"), "sub_class", F.lit(".n"), F.col("size"), F.lit(".s"), F.col("node"), F.lit(".mcs_nodes.csv"))
    parts = named_parts(name, r"^(.+)__(.+)\.n(\d+)\.([^.]+)\.mcs_nodes\.csv$", ["left_graph", "right_graph", "size", "sample"])
    log = F.regexp_replace(name, r"\.mcs_nodes\.csv$", ".stdout.log")
    return a.select("node", parts.alias("p"), t.sample_id(F.lit(None).cast("string"), log).alias("from_log")).select("node", "p.*", "from_log")


@query("SELECT p_partkey::BIGINT AS node, p_partkey::DOUBLE * 1000 + p_size AS number, p_partkey + p_size AS arrow_sum, p_partkey::BIGINT AS last, regexp_replace(lower(p_type || ' (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g').trim('_') AS slug FROM part")
def parsed_numbers(spark, d):
    """Numbers with thousands separators before words, rows with arrows, summary lines, slugs."""
    a, n, s = annotations(spark, d), F.col("node"), F.col("size")
    shown = F.concat(F.format_number(n * 1000 + s, 0), F.lit(" synapses"))
    arrow = t.arrow_row(F.concat(F.lit(" "), n, F.lit(" -> "), s, F.lit("->"), n))
    return a.select("node", t.numeric_prefix(shown).alias("number"), (arrow[0] + arrow[1]).alias("arrow_sum"), arrow[2].alias("last"), t.slug(F.concat("primary_type", F.lit(" ("), "sub_class", F.lit(")"))).alias("slug"))


@query("SELECT * FROM (VALUES ('Neurons', '1,204 (in 3)'), ('Synapses', '9')) v(key, text)")
def summary_lines(spark, d):
    lines = [(1, "- Neurons: 7"), (2, "Synapses: 9"), (3, "- Neurons: 1,204 (in 3)"), (4, "no key"), (5, "")]
    return summary_values(spark.createDataFrame(lines, "line_no long, value string"))


@query("SELECT graph, count(*) AS nodes, sum(outs)::BIGINT AS outs FROM (SELECT graph, node, (SELECT count(*) FROM edges e WHERE e.graph = n.graph AND e.src = n.node) AS outs FROM nodes n) GROUP BY graph")
def degree_windows(spark, d):
    """Nodes and edges of each graph by a window over its labels, cached labels used twice."""
    marked = pt.labels(edges_of(spark, d)).withColumn("nodes", F.count("*").over(Window.partitionBy("graph")))
    return marked.groupBy("graph").agg(F.max("nodes").alias("nodes"), F.sum("outs").alias("outs"))
