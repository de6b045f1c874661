"""Registered queries that hold mappings against graphs: planted sound ones, and broken ones of each kind.

Graph B is A with other ids, C is B without some edges; N2 and R2 are N and R with other ids. So mappings are never the identity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import graph as g
from skein.operators import summary as su
from skein.operators import verification as v
from skein.plans.numbering import numbered
from skein.plans.staging import stage
from skein.queries import _nodeset, common_nodes, query
from skein.sources.edges import edges_of

_GRAPHS = """g AS (SELECT graph, src, dst FROM edges UNION ALL SELECT 'B', src * 2 + 1, dst * 2 + 1 FROM ea UNION ALL SELECT 'C', src * 2 + 1, dst * 2 + 1 FROM ea WHERE (src + dst) % 11 <> 0
  UNION ALL SELECT 'N2', src + 5000000, dst + 5000000 FROM edges WHERE graph = 'N' UNION ALL SELECT 'R2', 9000000 - src, 9000000 - dst FROM edges WHERE graph = 'R'),
gn AS (SELECT graph, src AS node FROM g UNION SELECT graph, dst FROM g)"""

#: Sound, edges missing, a pair twice, a pair outside of the graphs.
_PAIRS = f"""{_GRAPHS},
m0 AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS pos FROM nodes WHERE graph = 'A' AND node IN (SELECT node FROM nodeset)),
pairs AS MATERIALIZED (SELECT 'sound' AS mapping, pos, 'A' AS left_graph, 'B' AS right_graph, node AS l, node * 2 + 1 AS r FROM m0 UNION ALL SELECT 'lacking', pos, 'A', 'C', node, node * 2 + 1 FROM m0
  UNION ALL SELECT 'twice', pos, 'A', 'B', node, node * 2 + 1 FROM m0 UNION ALL SELECT 'twice', count(*), 'A', 'B', min(node), max(node) * 2 + 1 FROM m0
  UNION ALL SELECT 'foreign', pos, 'A', 'B', node, node * 2 + 1 FROM m0 UNION ALL SELECT 'foreign', count(*), 'A', 'B', -7, -8 FROM m0),
corr AS MATERIALIZED (SELECT mapping, pos, 'left' AS side, left_graph AS graph, l AS node FROM pairs UNION ALL SELECT mapping, pos, 'right', right_graph, r FROM pairs)"""

#: Components of the sides of mappings by walking; needs corr, and ind (mapping, side, src, dst).
_SHAPES = """members AS MATERIALIZED (SELECT DISTINCT mapping, side, node FROM corr),
step(mapping, side, a, b) AS (SELECT mapping, side, node, node FROM members UNION SELECT s.mapping, s.side, s.a, i.b FROM step s JOIN (SELECT mapping, side, src AS a, dst AS b FROM ind UNION SELECT mapping, side, dst, src FROM ind) i ON i.mapping = s.mapping AND i.side = s.side AND i.a = s.b),
reach(mapping, side, a, b) AS (SELECT mapping, side, node, node FROM members UNION SELECT s.mapping, s.side, s.a, i.dst FROM reach s JOIN ind i ON i.mapping = s.mapping AND i.side = s.side AND i.src = s.b),
weak AS (SELECT mapping, side, count(*) AS weak_components, max(n) AS largest_weak, count_if(n = 1)::BIGINT AS weak_singletons FROM (SELECT mapping, side, c, count(*) AS n FROM (SELECT mapping, side, a, min(b) AS c FROM step GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
strong AS (SELECT mapping, side, count(*) AS strong_components, max(n) AS largest_strong FROM (SELECT mapping, side, c, count(*) AS n FROM (SELECT x.mapping, x.side, x.a, min(x.b) AS c FROM reach x JOIN reach y ON x.mapping = y.mapping AND x.side = y.side AND x.a = y.b AND x.b = y.a GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
shape AS (SELECT * FROM weak JOIN strong USING (mapping, side))"""


def _ind(loops: bool, edges: str = "g") -> str:
    return f"SELECT DISTINCT s.mapping, s.side, e.src, e.dst FROM {edges} e JOIN corr s ON s.graph = e.graph AND s.node = e.src JOIN corr t ON t.graph = e.graph AND t.node = e.dst AND t.mapping = s.mapping AND t.side = s.side" + ("" if loops else " WHERE e.src <> e.dst")


def _differ(ind: str) -> str:
    """(mapping, missing, extra) by NOT EXISTS over the sides of ``ind``."""
    mapped = f"SELECT DISTINCT i.mapping, a.r AS src, b.r AS dst FROM {ind} i JOIN last a ON a.mapping = i.mapping AND a.l = i.src JOIN last b ON b.mapping = i.mapping AND b.l = i.dst WHERE i.side = 'left'"
    right = f"SELECT mapping, src, dst FROM {ind} WHERE side = 'right'"
    return f"SELECT mapping, (SELECT count(*) FROM (({mapped}) EXCEPT ({right})) x WHERE x.mapping = p.mapping) AS missing, (SELECT count(*) FROM (({right}) EXCEPT ({mapped})) x WHERE x.mapping = p.mapping) AS extra FROM (SELECT DISTINCT mapping FROM pairs) p"


_LAST = "last AS MATERIALIZED (SELECT mapping, l, arg_max(r, pos) AS r FROM pairs GROUP BY mapping, l)"
_FACTS = """facts AS MATERIALIZED (SELECT c.mapping, c.side, max(c.graph) AS graph, count(*) AS nodes, count(DISTINCT c.node) < count(*) AS duplicate, bool_and((c.graph, c.node) IN (SELECT graph, node FROM gn)) AS in_raw,
  (SELECT count(*) FROM ind i WHERE i.mapping = c.mapping AND i.side = c.side) AS edges FROM corr c GROUP BY c.mapping, c.side)"""

_VERIFIED = f"""{_PAIRS}, ind AS MATERIALIZED ({_ind(True)}), {_SHAPES}, {_LAST}, {_FACTS}, fs AS (SELECT *, weak_components = 1 AS connected FROM facts JOIN shape USING (mapping, side)), d AS MATERIALIZED ({_differ("ind")}),
verified AS (SELECT l.mapping, l.nodes, """ + ", ".join(f"{s[0]}.{c} AS {s}_{c}" for s in ("left", "right") for c in ("graph", "duplicate", "in_raw", "edges", "weak_components", "largest_weak", "strong_components", "largest_strong", "connected")) + """,
  missing, extra, NOT l.duplicate AND NOT r.duplicate AND l.in_raw AND r.in_raw AND missing = 0 AND extra = 0 AS valid, l.edges = 0 AND r.edges = 0 AS edgeless
  FROM fs l JOIN fs r ON l.mapping = r.mapping AND l.side = 'left' AND r.side = 'right' JOIN d ON d.mapping = l.mapping)"""


def _wrap(ctes: str, body: str) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {ctes}\n{body})"


def _graphs(spark: SparkSession, d: str) -> DataFrame:
    e = edges_of(spark, d)
    a = e.where("graph = 'A'")

    def renamed(rows: DataFrame, name: str, new) -> DataFrame:
        return rows.select(F.lit(name).alias("graph"), new(F.col("src")).alias("src"), new(F.col("dst")).alias("dst"))

    odd = lambda x: x * 2 + 1
    parts = [renamed(a, "B", odd), renamed(a.where("(src + dst) % 11 <> 0"), "C", odd), renamed(e.where("graph = 'N'"), "N2", lambda x: x + 5000000), renamed(e.where("graph = 'R'"), "R2", lambda x: 9000000 - x)]
    for p in parts:
        e = e.unionByName(p)
    return stage(e, "graphs")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    m = numbered(g.nodes_of(edges_of(spark, d, "A")).join(_nodeset(spark, d), "node", "left_semi"), [], ["node"], "pos")
    m = stage(m, "planted")
    whole = m.agg(F.count("*").alias("pos"), F.min("node").alias("lo"), F.max("node").alias("hi"))

    def rows(name: str, right: str, of: DataFrame = m, l: str = "node", r: str = "node * 2 + 1") -> DataFrame:
        return of.selectExpr(f"'{name}' AS mapping", "pos", "'A' AS left_graph", f"'{right}' AS right_graph", f"CAST({l} AS BIGINT) AS l", f"CAST({r} AS BIGINT) AS r")

    out = rows("sound", "B")
    for x in (rows("lacking", "C"), rows("twice", "B"), rows("twice", "B", whole, "lo", "hi * 2 + 1"), rows("foreign", "B"), rows("foreign", "B", whole, "-7", "-8")):
        out = out.unionByName(x)
    return out


@query(_wrap(_VERIFIED, "SELECT * FROM verified"))
def pair_verified(spark, d):
    return v.verify_pairs(_pairs(spark, d), _graphs(spark, d))


@query(_wrap(_VERIFIED, """SELECT count(*) AS rows, count_if(valid)::BIGINT AS valid, count_if(NOT valid)::BIGINT AS invalid, count_if(left_connected AND right_connected)::BIGINT AS both_connected, count_if(edgeless)::BIGINT AS both_edgeless,
min(least(left_edges, right_edges)) AS min_side_min, max(least(left_edges, right_edges)) AS min_side_max, avg(least(left_edges, right_edges)) AS min_side_mean, median(least(left_edges, right_edges)) AS min_side_median,
min(greatest(left_edges, right_edges)) AS max_side_min, max(greatest(left_edges, right_edges)) AS max_side_max, avg(greatest(left_edges, right_edges)) AS max_side_mean, median(greatest(left_edges, right_edges)) AS max_side_median FROM verified"""))
def verification_summary(spark, d):
    """Counts by condition, and statistics of the lesser and the greater side."""
    rows = stage(pair_verified(spark, d), "verified")
    least, most = F.least("left_edges", "right_edges"), F.greatest("left_edges", "right_edges")
    ways = [s.alias(f"{name}_{k}") for name, x in (("min_side", least), ("max_side", most)) for s, k in zip(su.stats(x), ("min", "max", "mean", "median"), strict=True)]
    return rows.agg(F.count("*").alias("rows"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("left_connected") & F.col("right_connected")).alias("both_connected"), F.count_if("edgeless").alias("both_edgeless"), *ways)


@query(_wrap(f"{_PAIRS}, ind AS MATERIALIZED ({_ind(True)})", "SELECT mapping, sum(least(l, r))::BIGINT AS edges, sum(l)::BIGINT AS left_edges, sum(r)::BIGINT AS right_edges FROM (SELECT mapping, count_if(side = 'left') AS l, count_if(side = 'right') AS r FROM ind GROUP BY mapping) GROUP BY mapping"))
def mapped_edge_counts(spark, d):
    """Induced edges of each side of a mapping, and of the lesser side."""
    ind = v.induced_by_mapping(v.from_pairs(_pairs(spark, d)), _graphs(spark, d))
    per = ind.groupBy("mapping").agg(*[F.count_if(F.col("side") == s).alias(f"{s}_edges") for s in ("left", "right")])
    return per.withColumn("edges", F.least("left_edges", "right_edges"))


_RAW = f"""{_PAIRS}, {_LAST}, gs AS (SELECT * FROM g WHERE (src * 7 + dst) % 13 <> 0 OR graph <> 'C'), ind AS MATERIALIZED ({_ind(True)}), inds AS MATERIALIZED ({_ind(True, "gs")}), gsn AS (SELECT graph, src AS node FROM gs UNION SELECT graph, dst FROM gs),
dr AS MATERIALIZED ({_differ("ind")}), ds AS MATERIALIZED ({_differ("inds")}),
f AS (SELECT mapping, count(*) / 2 AS nodes, bool_or(twice) AS twice, bool_and(raw) AS raw, bool_and(sample) AS sample FROM (SELECT c.*, count(*) OVER (PARTITION BY mapping, side, node) > 1 AS twice, (graph, node) IN (SELECT graph, node FROM gn) AS raw, (graph, node) IN (SELECT graph, node FROM gsn) AS sample FROM corr c) GROUP BY mapping),
n AS (SELECT mapping, (SELECT count(*) FROM inds i WHERE i.mapping = f.mapping AND side = 'left') AS sl, (SELECT count(*) FROM inds i WHERE i.mapping = f.mapping AND side = 'right') AS sr, (SELECT count(*) FROM ind i WHERE i.mapping = f.mapping AND side = 'left') AS rl, (SELECT count(*) FROM ind i WHERE i.mapping = f.mapping AND side = 'right') AS rr FROM f)"""


@query(_wrap(_RAW, """SELECT mapping, nodes::BIGINT AS nodes, sl AS sample_left_edges, sr AS sample_right_edges, ds.missing AS sample_missing, ds.extra AS sample_extra, NOT twice AND sample AND ds.missing = 0 AND ds.extra = 0 AS sample_valid,
sl / greatest(1, nodes * (nodes - 1)) AS left_density, sr / greatest(1, nodes * (nodes - 1)) AS right_density, rl AS raw_left_edges, rr AS raw_right_edges, dr.missing AS raw_missing, dr.extra AS raw_extra, NOT twice AND raw AND dr.missing = 0 AND dr.extra = 0 AS raw_valid,
sl = rl AS left_sample_is_raw, sr = rr AS right_sample_is_raw, NOT twice AND raw AND sample AND ds.missing = 0 AND ds.extra = 0 AND dr.missing = 0 AND dr.extra = 0 AND sl = rl AND sr = rr AS passed
FROM f JOIN n USING (mapping) JOIN ds USING (mapping) JOIN dr USING (mapping)"""))
def sample_raw_verified(spark, d):
    """Mappings held against samples (here the graphs, C without more edges) and against the raw graphs."""
    graphs = _graphs(spark, d)
    return v.verify_samples(_pairs(spark, d), graphs.where("(src * 7 + dst) % 13 <> 0 or graph <> 'C'"), graphs)


_THREE = f"""{_GRAPHS}, k AS (SELECT node FROM nodes GROUP BY node HAVING count(DISTINCT graph) = 3),
agreed AS (SELECT node FROM k WHERE node NOT IN (SELECT greatest(src, dst) FROM edges WHERE src <> dst GROUP BY src, dst HAVING count(*) < 3)),
m1 AS (SELECT 'agreed' AS mapping, node, row_number() OVER (ORDER BY node DESC) - 1 AS pos FROM agreed UNION ALL SELECT 'any', node, row_number() OVER (ORDER BY node DESC) - 1 FROM k WHERE node % 3 = 0),
m2 AS (SELECT * FROM m1 UNION ALL SELECT 'repeated', node, pos FROM m1 WHERE mapping = 'agreed' UNION ALL SELECT 'repeated', min(node), count(*) FROM m1 WHERE mapping = 'agreed'),
corr AS MATERIALIZED (SELECT mapping, pos, 'a' AS side, 'A' AS graph, node FROM m2 UNION ALL SELECT mapping, pos, 'b', 'N2', node + 5000000 FROM m2 UNION ALL SELECT mapping, pos, 'c', 'R2', 9000000 - node FROM m2),
ind AS MATERIALIZED ({_ind(False)}), {_SHAPES}, {_FACTS}, lastpos AS (SELECT mapping, side, node, max(pos) AS pos FROM corr GROUP BY ALL),
place AS MATERIALIZED (SELECT i.mapping, i.side, s.pos AS u, t.pos AS w FROM ind i JOIN lastpos s ON s.mapping = i.mapping AND s.side = i.side AND s.node = i.src JOIN lastpos t ON t.mapping = i.mapping AND t.side = i.side AND t.node = i.dst),
three AS (SELECT x.mapping, x.nodes, """ + ", ".join(f"{v_}.{c} AS {s}_{c}" for s, v_ in zip("abc", "xyz", strict=True) for c in ("duplicate", "in_raw", "weak_components", "largest_weak", "weak_singletons", "strong_components", "largest_strong")) + ", " + ", ".join(f"{v_}.edges AS {s}_edges" for s, v_ in zip("abc", "xyz", strict=True)) + ", " + ", ".join(
    f"NOT EXISTS ((SELECT u, w FROM place p WHERE p.mapping = x.mapping AND side = '{p}' EXCEPT SELECT u, w FROM place p WHERE p.mapping = x.mapping AND side = '{q}') UNION ALL (SELECT u, w FROM place p WHERE p.mapping = x.mapping AND side = '{q}' EXCEPT SELECT u, w FROM place p WHERE p.mapping = x.mapping AND side = '{p}')) AS iso_{p}_{q}" for p, q in ("ab", "ac", "bc")) + """
  FROM (SELECT * FROM facts JOIN shape USING (mapping, side)) x JOIN (SELECT * FROM facts JOIN shape USING (mapping, side)) y ON y.mapping = x.mapping AND x.side = 'a' AND y.side = 'b' JOIN (SELECT * FROM facts JOIN shape USING (mapping, side)) z ON z.mapping = x.mapping AND z.side = 'c'),
verified AS (SELECT *, NOT a_duplicate AND NOT b_duplicate AND NOT c_duplicate AND a_in_raw AND b_in_raw AND c_in_raw AND iso_a_b AND iso_a_c AND iso_b_c AS isomorphic FROM three)"""


def _three(spark, d):
    e = edges_of(spark, d)
    k = stage(common_nodes(spark, d), "common")
    apart = g.agreement(e).where("graphs < 3").select(F.greatest("src", "dst").alias("node"))
    turned = lambda rows: numbered(rows.withColumn("neg", -F.col("node")), [], ["neg"], "pos").select("node", "pos")
    agreed = stage(turned(k.join(apart, "node", "left_anti")), "agreed")
    again = agreed.agg(F.min("node").alias("node"), F.count("*").alias("pos"))
    m = None
    for name, rows in (("agreed", agreed), ("any", turned(k.where("node % 3 = 0"))), ("repeated", agreed.unionByName(again))):
        rows = rows.select(F.lit(name).alias("mapping"), "node", "pos")
        m = rows if m is None else m.unionByName(rows)
    n = F.col("node")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(x).alias("graph"), y.alias("node")) for s, x, y in (("a", "A", n), ("b", "N2", n + 5000000), ("c", "R2", 9000000 - n))])
    return m.select("mapping", "pos", F.explode(sides).alias("x")).select("mapping", "pos", "x.*")


@query(_wrap(_THREE, "SELECT * FROM verified"))
def threeway_verified(spark, d):
    return v.verify_many(_three(spark, d), _graphs(spark, d), ["a", "b", "c"])


_METRICS = {"threeway_nodes": "nodes", "edges_no_self_loops": "a_edges", "weak_components": "a_weak_components", "largest_weak_component": "a_largest_weak", "isolated_nodes_weak": "a_weak_singletons", "strong_components": "a_strong_components", "largest_strong_component": "a_largest_strong"}


@query(_wrap(_THREE, "SELECT count(*) AS rows_analyzed, count_if(isomorphic)::BIGINT AS isomorphic_rows, count_if(NOT isomorphic)::BIGINT AS other_rows, " + ", ".join(f"{f}({c}) FILTER (isomorphic)::DOUBLE AS {m}_{k}" for m, c in _METRICS.items() for f, k in (("min", "min"), ("max", "max"), ("avg", "mean"), ("median", "median"))) + " FROM verified"))
def run_summary(spark, d):
    """Three counters, and statistics of seven metrics over the rows that are isomorphic."""
    rows = stage(threeway_verified(spark, d), "verified")
    iso = F.col("isomorphic")
    parts = [s.cast("double").alias(f"{m}_{k}") for m, c in _METRICS.items() for s, k in zip(su.stats(F.when(iso, F.col(c))), ("min", "max", "mean", "median"), strict=True)]
    return rows.agg(F.count("*").alias("rows_analyzed"), F.count_if(iso).alias("isomorphic_rows"), F.count_if(~iso).alias("other_rows"), *parts)


#: Places beside nodes: the sound mapping, one with a place out of range, one that the solver gave up, one that never ran.
_STORED = f"""{_PAIRS}, idx AS MATERIALIZED (SELECT graph, node, row_number() OVER (PARTITION BY graph ORDER BY node) - 1 AS idx FROM gn WHERE graph IN ('A', 'B')),
byidx AS (SELECT s.job AS mapping, p.pos, 'A' AS left_graph, 'B' AS right_graph, i.idx + CASE WHEN s.job = 'j2' AND p.pos = 3 THEN 90000000 ELSE 0 END AS li, j.idx AS ri FROM pairs p JOIN idx i ON i.graph = 'A' AND i.node = p.l JOIN idx j ON j.graph = 'B' AND j.node = p.r, (SELECT unnest(['j1', 'j2', 'j3', 'j4']) AS job) s WHERE p.mapping = 'sound'),
sums AS (SELECT * FROM (VALUES ('j1', '0', '1', 'A__B.n500.s1.stdout.log', ''), ('j2', 'skipped_existing', '1', 'A__B.n500.s2.stdout.log', 's2'), ('j3', '0', '0', 'logs/A__B.n500.seed7.stdout.log', NULL), ('j4', '124', '1', 'A__B.n500.s4.stdout.log', 's4')) t(mapping, returncode, valid_solution, stdout_log, given))"""


@query(_wrap(_STORED, """SELECT mapping, CASE mapping WHEN 'j1' THEN 's1' WHEN 'j2' THEN 's2' ELSE 'seed7' END AS sample_id, count(*) AS pairs, count_if(li > 1000000)::BIGINT AS out_of_range, count_if(li > 1000000) = 0 AS external, valid_solution = '1' AND count_if(li > 1000000) = 0 AS is_valid,
CASE WHEN valid_solution = '1' AND count_if(li > 1000000) = 0 THEN count(*) ELSE 0 END AS mapped_pairs FROM byidx JOIN sums USING (mapping) WHERE returncode IN ('0', 'skipped_existing') GROUP BY mapping, valid_solution"""))
def revalidated(spark, d):
    """Stored rows checked again: which are looked at, places out of range, solver's word and check both needed."""
    graphs = _graphs(spark, d)
    index = stage(numbered(g.nodes_of(graphs.where("graph in ('A', 'B')"), "graph"), ["graph"], ["node"]), "index")
    sound = _pairs(spark, d).where("mapping = 'sound'").select("pos", "l", "r", F.explode(F.array(*[F.lit(f"j{i}") for i in range(1, 5)])).alias("mapping"))
    a, b = (index.where(F.col("graph") == x).select(F.col("node").alias(c), F.col("idx").alias(f"{c}i")) for x, c in (("A", "l"), ("B", "r")))
    far = F.when((F.col("mapping") == "j2") & (F.col("pos") == 3), 90000000).otherwise(0)
    pairs = sound.join(a, "l").join(b, "r").select("mapping", "pos", F.lit("A").alias("left_graph"), F.lit("B").alias("right_graph"), (F.col("li") + far).alias("li"), "ri")
    stored = [("j1", "0", "1", "A__B.n500.s1.stdout.log", ""), ("j2", "skipped_existing", "1", "A__B.n500.s2.stdout.log", "s2"), ("j3", "0", "0", "logs/A__B.n500.seed7.stdout.log", None), ("j4", "124", "1", "A__B.n500.s4.stdout.log", "s4")]
    rows = spark.createDataFrame(stored, "mapping string, returncode string, valid_solution string, stdout_log string, sample_id string")
    return v.revalidate(rows, stage(pairs, "places"), index, graphs).select("mapping", "sample_id", "pairs", "out_of_range", "external", "is_valid", F.col("mapped_pairs").cast("long").alias("mapped_pairs"))
