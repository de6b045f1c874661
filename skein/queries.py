"""Registered graph queries over the succession graphs, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import type_or_untyped
from skein.operators import graph as g
from skein.operators.components import components
from skein.plans.numbering import numbered
from skein.sinks.tables import ranked_sizes
from skein.sources.edges import annotations, edges_of, succession

E = """rows0 AS (SELECT l_returnflag AS graph, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst,
  l_quantity::BIGINT AS syn_count, l_linestatus AS neuropil, l_quantity AS q FROM lineitem),
rows1 AS (SELECT graph, src::BIGINT AS src, dst::BIGINT AS dst, syn_count, neuropil FROM rows0 WHERE dst IS NOT NULL AND q >= 40),
edges AS (SELECT DISTINCT graph, src, dst FROM rows1),
ea AS (SELECT src, dst FROM edges WHERE graph = 'A'),
nodes AS (SELECT graph, src AS node FROM edges UNION SELECT graph, dst FROM edges),
nodeset AS (SELECT p_partkey::BIGINT AS node FROM part WHERE p_size <= 10)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {E}\n{sql}"
        return f

    return add


def _nodeset(spark: SparkSession, d: str) -> DataFrame:
    return annotations(spark, d).where("size <= 10").select("node")


@query("SELECT graph, src, dst FROM edges")
def edge_scan(spark, d):
    return edges_of(spark, d)


@query("SELECT graph, node FROM nodes")
def node_set(spark, d):
    return g.nodes_of(edges_of(spark, d), "graph")


@query("SELECT graph, src, dst FROM edges WHERE src <> dst")
def self_loop_filter(spark, d):
    return g.without_loops(edges_of(spark, d))


@query("SELECT graph, node, count(*) AS degree FROM (SELECT graph, src AS node FROM edges UNION ALL SELECT graph, dst FROM edges) GROUP BY ALL")
def total_degree(spark, d):
    return g.total_degree(edges_of(spark, d), "graph")


@query("SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM ea UNION ALL SELECT dst, 0, 1 FROM ea) GROUP BY node")
def in_out_distinct_degree(spark, d):
    return g.distinct_degrees(edges_of(spark, d, "A"))


@query("""SELECT graph, node, sum(CASE WHEN o THEN syn_count ELSE 0 END)::BIGINT AS weighted_out, sum(CASE WHEN o THEN 0 ELSE syn_count END)::BIGINT AS weighted_in, sum(syn_count)::BIGINT AS weighted
FROM (SELECT graph, src AS node, syn_count, true AS o FROM rows1 UNION ALL SELECT graph, dst, syn_count, false FROM rows1) GROUP BY graph, node""")
def weighted_degree(spark, d):
    return g.weighted_degrees(succession(spark, d), "graph")


@query("""SELECT src, dst, sum(n)::BIGINT AS rows, sum(s)::BIGINT AS syn_count, arg_min(neuropil, (-n, neuropil)) AS neuropil
FROM (SELECT src, dst, neuropil, count(*) AS n, sum(syn_count) AS s FROM rows1 GROUP BY ALL) GROUP BY src, dst""")
def multigraph_collapse(spark, d):
    return g.collapse(succession(spark, d))


@query("SELECT src, dst FROM ea WHERE src IN (SELECT node FROM nodeset) AND dst IN (SELECT node FROM nodeset)")
def induced_edges(spark, d):
    return g.induced(edges_of(spark, d, "A"), _nodeset(spark, d))


@query("""SELECT n.node, count(r.src) AS outdegree FROM nodeset n LEFT JOIN (SELECT src FROM rows1 WHERE src IN (SELECT node FROM nodeset) AND dst IN (SELECT node FROM nodeset)) r ON r.src = n.node GROUP BY n.node""")
def induced_outdegree(spark, d):
    nodes = _nodeset(spark, d)
    out = g.induced(succession(spark, d), nodes).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    return nodes.join(out, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("outdegree"))


@query("""SELECT direction, count(*) AS rows, sum(syn_count)::BIGINT AS syn_count FROM (SELECT syn_count, CASE WHEN s AND t THEN 'internal' WHEN s THEN 'outgoing' WHEN t THEN 'incoming' END AS direction
FROM (SELECT syn_count, src IN (SELECT node FROM nodeset) AS s, dst IN (SELECT node FROM nodeset) AS t FROM rows1)) WHERE direction IS NOT NULL GROUP BY direction""")
def boundary_edges(spark, d):
    return g.boundary(succession(spark, d), _nodeset(spark, d)).groupBy("direction").agg(F.count("*").alias("rows"), F.sum("syn_count").alias("syn_count"))


@query("SELECT node FROM nodes GROUP BY node HAVING count(DISTINCT graph) = 3")
def common_nodes(spark, d):
    return g.nodes_of(edges_of(spark, d), "graph").groupBy("node").agg(F.count_distinct("graph").alias("k")).where("k = 3").select("node")


@query("SELECT src, dst, count(DISTINCT graph) AS graphs FROM edges WHERE src <> dst GROUP BY src, dst")
def threeway_agreement(spark, d):
    return g.agreement(edges_of(spark, d))


@query("""SELECT status, count(*) AS edges FROM (SELECT 'missing' AS status, * FROM ((SELECT src, dst FROM edges WHERE graph = 'A' AND src <> dst AND src IN (SELECT node FROM (SELECT node FROM nodes GROUP BY node HAVING count(DISTINCT graph) = 3)) AND dst IN (SELECT node FROM (SELECT node FROM nodes GROUP BY node HAVING count(DISTINCT graph) = 3))) EXCEPT (SELECT src, dst FROM edges WHERE graph = 'N'))
UNION ALL SELECT 'extra', * FROM ((SELECT src, dst FROM edges WHERE graph = 'N' AND src <> dst AND src IN (SELECT node FROM (SELECT node FROM nodes GROUP BY node HAVING count(DISTINCT graph) = 3)) AND dst IN (SELECT node FROM (SELECT node FROM nodes GROUP BY node HAVING count(DISTINCT graph) = 3))) EXCEPT (SELECT src, dst FROM edges WHERE graph = 'A'))) GROUP BY status""")
def pair_missing_extra(spark, d):
    nodes = common_nodes(spark, d)
    a, n = (g.induced(edges_of(spark, d, x), nodes) for x in "AN")
    return g.pair_difference(a, n).groupBy("status").agg(F.count("*").alias("edges"))


@query("SELECT graph, node, row_number() OVER (PARTITION BY graph ORDER BY node) - 1 AS idx FROM nodes")
def index_map(spark, d):
    return numbered(g.nodes_of(edges_of(spark, d), "graph"), ["graph"], ["node"])


_WCC = """und AS (SELECT src AS a, dst AS b FROM ea UNION SELECT dst, src FROM ea),
walk(a, b) AS (SELECT a, a FROM und UNION SELECT walk.a, und.b FROM walk JOIN und ON walk.b = und.a),
wcc AS (SELECT a AS node, min(b) AS component FROM walk GROUP BY a)"""


@query(f"SELECT * FROM (WITH RECURSIVE {_WCC} SELECT node, component FROM wcc)")
def wcc_assign(spark, d):
    return components(edges_of(spark, d, "A"))


@query(f"SELECT * FROM (WITH RECURSIVE {_WCC} SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS rank FROM wcc GROUP BY component)")
def wcc_sizes(spark, d):
    return ranked_sizes(wcc_assign(spark, d))


@query(f"SELECT * FROM (WITH RECURSIVE {_WCC}, s AS (SELECT component, count(*) AS size FROM wcc GROUP BY component) SELECT count(*) AS components, count_if(size = 1)::BIGINT AS singletons, max(size) AS largest, max(size) / sum(size) AS fraction FROM s)")
def wcc_summary(spark, d):
    sizes = wcc_assign(spark, d).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("components"), F.count_if(F.col("size") == 1).alias("singletons"), F.max("size").alias("largest"), (F.max("size") / F.sum("size")).alias("fraction"))


@query("""SELECT p_type AS primary_type, count(*) AS cells, round_even(avg(od), 4) AS mean, median(od) AS median, max(od) AS max, sum(od)::BIGINT AS sum
FROM (SELECT p.p_type, (SELECT count(*) FROM ea WHERE ea.src = p.p_partkey) AS od FROM part p) GROUP BY p_type""")
def type_outdegree_stats(spark, d):
    out = edges_of(spark, d, "A").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    rows = annotations(spark, d).join(out, "node", "left").select(type_or_untyped(F.col("primary_type")).alias("primary_type"), F.coalesce("n", F.lit(0)).alias("od"))
    return rows.groupBy("primary_type").agg(F.count("*").alias("cells"), F.bround(F.avg("od"), 4).alias("mean"), F.median("od").alias("median"), F.max("od").alias("max"), F.sum("od").alias("sum"))


@query("SELECT p_brand AS label, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, label LIMIT 8")
def value_counts_topk(spark, d):
    return annotations(spark, d).groupBy(F.col("sub_class").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(8)


@query("SELECT sum(k)::BIGINT AS edges, 2.0::DOUBLE * (sum(k) - count(*))::DOUBLE / sum(k) AS reciprocity FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS k FROM ea WHERE src <> dst GROUP BY ALL)")
def reciprocity(spark, d):
    return g.reciprocity(edges_of(spark, d, "A"))


@query("""SELECT count(*) AS nodes, round(avg(c), 9) AS clustering FROM (
SELECT n.node, CASE WHEN k > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) ELSE 0.0 END AS c FROM (SELECT node FROM nodes WHERE graph = 'A') n
LEFT JOIN (SELECT a AS node, count(*) AS k FROM (SELECT src AS a, dst AS b FROM ea WHERE src <> dst UNION SELECT dst, src FROM ea WHERE src <> dst) GROUP BY a) USING (node)
LEFT JOIN (SELECT x.a AS node, count(*) AS t FROM (SELECT src AS a, dst AS b FROM ea WHERE src <> dst UNION SELECT dst, src FROM ea WHERE src <> dst) x JOIN (SELECT src AS a, dst AS b FROM ea WHERE src <> dst UNION SELECT dst, src FROM ea WHERE src <> dst) y ON x.a = y.a AND x.b < y.b JOIN (SELECT src AS a, dst AS b FROM ea UNION SELECT dst, src FROM ea) z ON z.a = x.b AND z.b = y.b GROUP BY x.a) USING (node))""")
def average_clustering(spark, d):
    return g.clustering(edges_of(spark, d, "A")).withColumn("clustering", F.round("clustering", 9))


@query("SELECT graph, n, m, m / greatest(1, n * (n - 1)) AS density FROM (SELECT graph, count(*) AS m FROM edges WHERE src <> dst GROUP BY graph) JOIN (SELECT graph, count(*) AS n FROM nodes GROUP BY graph) USING (graph)")
def graph_density(spark, d):
    e = edges_of(spark, d)
    n, m = g.nodes_of(e, "graph").groupBy("graph").agg(F.count("*").alias("n")), g.without_loops(e).groupBy("graph").agg(F.count("*").alias("m"))
    return n.join(m, "graph").withColumn("density", g.density(F.col("m"), F.col("n")))


@query("""SELECT node, min(hop) AS hop FROM (WITH near AS (SELECT src AS a, dst AS b FROM ea WHERE src <> dst UNION SELECT dst, src FROM ea WHERE src <> dst)
SELECT node, 0 AS hop FROM nodes WHERE graph = 'A' AND node = 1 UNION ALL SELECT b, 1 FROM near WHERE a = 1 UNION ALL SELECT y.b, 2 FROM near x JOIN near y ON x.b = y.a WHERE x.a = 1) GROUP BY node""")
def two_hop(spark, d):
    return g.within_two_hops(edges_of(spark, d, "A"), 1)


@query("""SELECT a.graph AS left_graph, b.graph AS right_graph, a.n AS left_nodes, b.n AS right_nodes FROM (SELECT graph, count(*) AS n FROM nodes GROUP BY graph) a JOIN (SELECT graph, count(*) AS n FROM nodes GROUP BY graph) b ON a.graph < b.graph""")
def pair_jobs(spark, d):
    n = g.nodes_of(edges_of(spark, d), "graph").groupBy("graph").agg(F.count("*").alias("n"))
    a, b = (n.select(F.col("graph").alias(f"{s}_graph"), F.col("n").alias(f"{s}_nodes")) for s in ("left", "right"))
    return a.join(b, F.col("left_graph") < F.col("right_graph"))
