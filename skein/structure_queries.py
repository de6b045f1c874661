"""Registered queries on structure: strong components, roles, mappings, samples, common subgraphs, log text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as t
from skein.operators import common_subgraph as mcs
from skein.operators import graph as g
from skein.operators import sampling as sample
from skein.operators import strong
from skein.plans.numbering import numbered
from skein.plans.staging import stage
from skein.queries import QUERIES as QUERIES
from skein.queries import SQL as SQL
from skein.queries import _nodeset, common_nodes, query, wcc_assign
from skein.sinks.tables import ranked_sizes
from skein.sources.edges import annotations, edges_of, succession

#: Sample sizes of the registered samplers and solver jobs: parameters of the sampling operators.
SAMPLE, JOB_SAMPLE = 150, 40

_SCC = """reach(a, b) AS (SELECT node, node FROM nodes WHERE graph = 'A' UNION SELECT reach.a, ea.dst FROM reach JOIN ea ON reach.b = ea.src),
scc AS MATERIALIZED (SELECT r.a AS node, min(r.b) AS component FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a GROUP BY r.a),
ce AS MATERIALIZED (SELECT x.component AS src, y.component AS dst FROM ea JOIN scc x ON x.node = ea.src JOIN scc y ON y.node = ea.dst),
dag AS MATERIALIZED (SELECT DISTINCT src, dst FROM ce WHERE src <> dst),
lev(node, level) AS (SELECT DISTINCT component, 0 FROM scc UNION SELECT dag.dst, level + 1 FROM lev JOIN dag ON lev.node = dag.src)"""
_FEATURES = f"""{_SCC},
feat0 AS (SELECT component, count(*) AS size, (SELECT count(*) FROM dag WHERE src = component) AS dag_outdegree, (SELECT count(*) FROM dag WHERE dst = component) AS dag_indegree,
  (SELECT max(level) FROM lev WHERE lev.node = component)::BIGINT AS dag_level, (SELECT count(*) FROM ce WHERE src = component AND dst <> component) AS external_out_edges,
  (SELECT count(*) FROM ce WHERE dst = component AND src <> component) AS external_in_edges, (SELECT count(*) FROM ce WHERE src = component AND dst = component) AS internal_edges FROM scc GROUP BY component),
feat AS MATERIALIZED (SELECT *, dag_outdegree - dag_indegree + external_out_edges - external_in_edges AS source_like_score, dag_indegree = 0 AS is_source,
  dag_outdegree >= 2 AND dag_outdegree > dag_indegree AND external_out_edges >= external_in_edges AS is_source_like_hub FROM feat0),
roles AS (SELECT scc.node, feat.*, CASE WHEN component = (SELECT component FROM feat ORDER BY size DESC, component LIMIT 1) THEN 'recurrent_core' WHEN is_source_like_hub THEN 'source_hub'
  WHEN dag_outdegree = 0 AND dag_indegree > 0 THEN 'sink' ELSE 'intermediate' END AS role FROM scc JOIN feat USING (component)),
typed AS (SELECT roles.role, p_type AS label FROM roles JOIN part ON p_partkey = roles.node)"""


def _inner(ctes: str, body: str) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {ctes}\n{body})"


@query(_inner(_SCC, "SELECT node, component FROM scc"))
def scc_assign(spark: SparkSession, d: str) -> DataFrame:
    return strong.strong_components(edges_of(spark, d, "A"))


@query(_inner(_SCC, "SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS rank FROM scc GROUP BY component"))
def scc_sizes(spark, d):
    return ranked_sizes(scc_assign(spark, d))


@query(_inner(_SCC, "SELECT count(*) AS components, count_if(size = 1)::BIGINT AS singletons, max(size) AS largest, max(size) / sum(size) AS fraction FROM (SELECT count(*) AS size FROM scc GROUP BY component)"))
def scc_summary(spark, d):
    sizes = scc_assign(spark, d).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("components"), F.count_if(F.col("size") == 1).alias("singletons"), F.max("size").alias("largest"), (F.max("size") / F.sum("size")).alias("fraction"))


def _condensed(spark, d):
    return strong.condensed(edges_of(spark, d, "A"), stage(scc_assign(spark, d), "scc"))


@query(_inner(_SCC, "SELECT src, dst FROM dag"))
def condensation_edges(spark, d):
    return _condensed(spark, d).where("src <> dst").distinct()


@query(_inner(_SCC, "SELECT count(*) AS edges, count_if(src = dst)::BIGINT AS internal, (SELECT count(*) FROM dag) AS dag_edges, (count_if(src <> dst) - (SELECT count(*) FROM dag))::BIGINT AS parallel FROM ce"))
def condensation_accounting(spark, d):
    per = _condensed(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n")).withColumn("cross", F.col("src") != F.col("dst"))
    inside, dag, cross = F.sum(F.when(~F.col("cross"), F.col("n")).otherwise(0)), F.count_if("cross"), F.sum(F.when(F.col("cross"), F.col("n")).otherwise(0))
    return per.agg(F.sum("n").alias("edges"), inside.alias("internal"), dag.alias("dag_edges"), (cross - dag).alias("parallel"))


@query(_inner(_SCC, "SELECT node, max(level)::BIGINT AS level FROM lev WHERE node IN (SELECT src FROM dag UNION SELECT dst FROM dag) GROUP BY node"))
def dag_levels(spark, d):
    return strong.dag_levels(condensation_edges(spark, d))


@query(_inner(_SCC, "SELECT max(level)::BIGINT AS longest FROM lev"))
def dag_longest_path(spark, d):
    return dag_levels(spark, d).agg(F.coalesce(F.max("level"), F.lit(0)).alias("longest"))


def _features(spark, d):
    labels = stage(scc_assign(spark, d), "scc")
    return labels, strong.component_features(edges_of(spark, d, "A"), labels)


@query(_inner(_FEATURES, "SELECT * FROM feat"))
def scc_features(spark, d):
    return _features(spark, d)[1]


@query(_inner(_FEATURES, "SELECT component, size, source_like_score FROM feat WHERE is_source_like_hub"))
def source_like_hubs(spark, d):
    return scc_features(spark, d).where("is_source_like_hub").select("component", "size", "source_like_score")


@query(_inner(_FEATURES, "SELECT node, component, role, dag_level FROM roles"))
def node_roles(spark, d):
    return strong.node_roles(*_features(spark, d)).select("node", "component", "role", "dag_level")


@query(_inner(_FEATURES, "SELECT role, count(*) AS nodes FROM roles GROUP BY role"))
def role_counts(spark, d):
    return node_roles(spark, d).groupBy("role").agg(F.count("*").alias("nodes"))


def _typed(spark, d):
    return node_roles(spark, d).join(annotations(spark, d), "node").select("role", t.type_or_untyped(F.col("primary_type")).alias("label"))


@query(_inner(_FEATURES, """SELECT role, label AS annotation, role_count, background_count, round_even(rf, 4) AS role_fraction, round_even(bf, 4) AS background_fraction, round_even(rf / bf, 4) AS fold_enrichment
FROM (SELECT *, role_count / sum(role_count) OVER (PARTITION BY role) AS rf, background_count / sum(role_count) OVER () AS bf
FROM (SELECT role, label, count(*) AS role_count FROM typed GROUP BY ALL) JOIN (SELECT label, count(*) AS background_count FROM typed GROUP BY label) USING (label)) WHERE role_count >= 3"""))
def role_enrichment(spark, d):
    return strong.enrichment(_typed(spark, d), "label")


@query(_inner(_FEATURES, "SELECT label, " + ", ".join(f"count_if(role = '{r}')::BIGINT AS {r}" for r in strong.ROLES) + " FROM typed GROUP BY label"))
def role_pivot(spark, d):
    return _typed(spark, d).groupBy("label").pivot("role", list(strong.ROLES)).count().na.fill(0)


@query("""SELECT * FROM (WITH RECURSIVE und AS (SELECT src AS a, dst AS b FROM ea UNION SELECT dst, src FROM ea), walk(a, b) AS (SELECT a, a FROM und UNION SELECT walk.a, und.b FROM walk JOIN und ON walk.b = und.a),
wcc AS (SELECT a AS node, min(b) AS component FROM walk GROUP BY a) SELECT node FROM wcc WHERE component = (SELECT component FROM wcc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1))""")
def largest_wcc(spark, d):
    of = stage(wcc_assign(spark, d), "wcc")
    largest = of.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return of.join(F.broadcast(largest), "component").select("node")


@query("SELECT n, m, m / greatest(1, n * (n - 1)) AS density FROM (SELECT count(*) AS n FROM nodeset), (SELECT count(*) AS m FROM ea WHERE src <> dst AND src IN (SELECT node FROM nodeset) AND dst IN (SELECT node FROM nodeset))")
def induced_density(spark, d):
    nodes = _nodeset(spark, d)
    m = g.without_loops(g.induced(edges_of(spark, d, "A"), nodes)).agg(F.count("*").alias("m"))
    return nodes.agg(F.count("*").alias("n")).join(m).withColumn("density", g.density(F.col("m"), F.col("n")))


@query("SELECT p_brand AS label FROM (SELECT DISTINCT graph, p_brand FROM nodes JOIN part ON p_partkey = node) GROUP BY p_brand HAVING count(*) = 3")
def common_labels(spark, d):
    labels = g.nodes_of(edges_of(spark, d), "graph").join(annotations(spark, d), "node").select("graph", F.col("sub_class").alias("label"))
    return labels.groupBy("label").agg(F.count_distinct("graph").alias("k")).where("k = 3").select("label")


_COMMON = "SELECT node FROM nodes GROUP BY node HAVING count(DISTINCT graph) = 3"
_POS = f"pos AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS pos FROM ({_COMMON}))"


def _identity(spark, d):
    """(pos, node) of the nodes that all graphs have, by ascending id."""
    from skein.sinks.text import placed

    return placed(common_nodes(spark, d), 0).withColumnRenamed("idx", "pos")


@query(_inner(_POS, "SELECT DISTINCT s.pos AS src_pos, t.pos AS dst_pos FROM ea JOIN pos s ON s.node = src JOIN pos t ON t.node = dst WHERE src <> dst"))
def positional_edges(spark, d):
    return g.positional(edges_of(spark, d, "A"), _identity(spark, d))


def _valid_sql(nodes: str) -> str:
    return f"""SELECT (SELECT count(*) FROM ({nodes})) AS nodes, count(*) AS edges, count(*) FILTER (k = 3) AS shared, count(*) FILTER (a <> n) AS an, count(*) FILTER (a <> r) AS ar, count(*) FILTER (n <> r) AS nr, count(*) = count(*) FILTER (k = 3) AS valid
FROM (SELECT src, dst, count(*) AS k, bool_or(graph = 'A') AS a, bool_or(graph = 'N') AS n, bool_or(graph = 'R') AS r FROM edges WHERE src <> dst AND src IN ({nodes}) AND dst IN ({nodes}) GROUP BY src, dst)"""


def _valid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    per = g.without_loops(g.induced(edges, nodes)).groupBy("src", "dst").agg(F.count("*").alias("k"), *[F.bool_or(F.col("graph") == x.upper()).alias(x) for x in "anr"])
    apart = [F.count_if(F.col(x) != F.col(y)).alias(x + y) for x, y in ("an", "ar", "nr")]
    flags = per.agg(F.count("*").alias("edges"), F.count_if(F.col("k") == 3).alias("shared"), *apart, (F.count("*") == F.count_if(F.col("k") == 3)).alias("valid"))
    return nodes.agg(F.count("*").alias("nodes")).join(flags)


@query(_valid_sql(_COMMON))
def threeway_valid(spark, d):
    return _valid(edges_of(spark, d), common_nodes(spark, d))


_AGREED = f"SELECT node FROM ({_COMMON}) WHERE node NOT IN (SELECT greatest(src, dst) FROM edges WHERE src <> dst GROUP BY src, dst HAVING count(*) < 3)"


@query(_valid_sql(_AGREED))
def threeway_valid_planted(spark, d):
    """Of every edge that some graph lacks, the greater end is left out: what stays agrees."""
    e = edges_of(spark, d)
    apart = g.agreement(e).where("graphs < 3").select(F.greatest("src", "dst").alias("node"))
    return _valid(e, common_nodes(spark, d).join(apart, "node", "left_anti"))


@query(f"SELECT count_if(status = 'missing')::BIGINT AS missing, count_if(status = 'extra')::BIGINT AS extra, count(*) = 0 AS valid FROM (SELECT CASE WHEN bool_or(graph = 'A') THEN 'missing' ELSE 'extra' END AS status FROM edges WHERE graph IN ('A', 'N') AND src <> dst AND src IN ({_COMMON}) AND dst IN ({_COMMON}) GROUP BY src, dst HAVING count(*) = 1)")
def pair_valid(spark, d):
    a, n = (g.induced(edges_of(spark, d, x), common_nodes(spark, d)) for x in "AN")
    s = F.col("status")
    return g.pair_difference(a, n).agg(F.count_if(s == "missing").alias("missing"), F.count_if(s == "extra").alias("extra"), (F.count("*") == 0).alias("valid"))


@query("SELECT graph, count(*) AS n, min(dg) AS min, max(dg) AS max, avg(dg) AS mean, median(dg) AS median FROM (SELECT graph, node, count(*) AS dg FROM (SELECT graph, src AS node FROM edges UNION ALL SELECT graph, dst FROM edges) GROUP BY ALL) GROUP BY graph")
def numeric_stats(spark, d):
    x = F.col("degree")
    return g.total_degree(edges_of(spark, d), "graph").groupBy("graph").agg(F.count("*").alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.median(x).alias("median"))


@query("SELECT graph, neuropil, count(*) AS rows, sum(syn_count)::BIGINT AS total, min(syn_count) AS min, median(syn_count) AS median, max(syn_count) AS max FROM rows1 GROUP BY ALL")
def module_rollup(spark, d):
    s = F.col("syn_count")
    return succession(spark, d).groupBy("graph", "neuropil").agg(F.count("*").alias("rows"), F.sum(s).alias("total"), F.min(s).alias("min"), F.median(s).alias("median"), F.max(s).alias("max"))


@query("SELECT graph, node, degree, rank FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY degree DESC, node) AS rank FROM (SELECT graph, node, count(*) AS degree FROM (SELECT graph, src AS node FROM edges UNION ALL SELECT graph, dst FROM edges) GROUP BY ALL)) WHERE rank <= 10")
def top_hubs(spark, d):
    rank = F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("degree"), "node"))
    return g.total_degree(edges_of(spark, d), "graph").withColumn("rank", rank.cast("long")).where("rank <= 10")


_SIG = "sig AS (SELECT graph, node, count(DISTINCT o) AS outs, count(DISTINCT i) AS ins FROM (SELECT graph, src AS node, dst AS o, NULL AS i FROM edges UNION ALL SELECT graph, dst, NULL, src FROM edges) GROUP BY ALL)"


@query(_inner(_SIG, "SELECT outs, ins, count_if(graph = 'A')::BIGINT AS a, count_if(graph = 'N')::BIGINT AS n, count_if(graph = 'R')::BIGINT AS r FROM sig GROUP BY outs, ins HAVING count(DISTINCT graph) = 3"))
def degree_signature_patterns(spark, d):
    e = edges_of(spark, d)
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    sig = e.select("graph", ends.alias("e")).groupBy("graph", "e.node").agg(F.sum("e.o").alias("outs"), F.sum("e.i").alias("ins"))
    per = sig.groupBy("outs", "ins").agg(*[F.count_if(F.col("graph") == x.upper()).alias(x) for x in "anr"])
    return per.where("a > 0 and n > 0 and r > 0")


@query("SELECT 'A-N-R' AS triplet, l.graph AS left_graph, r.graph AS right_graph, h.graph AS heldout FROM (SELECT DISTINCT graph FROM edges) l, (SELECT DISTINCT graph FROM edges) r, (SELECT DISTINCT graph FROM edges) h WHERE l.graph < r.graph AND h.graph NOT IN (l.graph, r.graph)")
def triplet_jobs(spark, d):
    names = edges_of(spark, d).select("graph").distinct()
    l, r, h = (names.select(F.col("graph").alias(x)) for x in ("left_graph", "right_graph", "heldout"))
    met = l.join(r, F.col("left_graph") < F.col("right_graph")).join(h, (F.col("heldout") != F.col("left_graph")) & (F.col("heldout") != F.col("right_graph")))
    return met.select(F.array_join(F.array_sort(F.array("left_graph", "right_graph", "heldout")), "-").alias("triplet"), "left_graph", "right_graph", "heldout")


@query("""SELECT job, node, score, rank FROM (SELECT *, coalesce(sum(valid) OVER (PARTITION BY job ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
(SELECT graph AS job, src AS node, count(*) AS score, (count(*) % 2)::INT AS valid, row_number() OVER (PARTITION BY graph ORDER BY count(*) DESC, src) AS rank FROM edges GROUP BY graph, src)) WHERE before < 5""")
def topk_valid_incumbents(spark, d):
    """Ranked candidates of a job until five valid ones came; earlier invalid ones are listed too."""
    rows = edges_of(spark, d).groupBy(F.col("graph").alias("job"), F.col("src").alias("node")).agg(F.count("*").alias("score"))
    ranks = stage(numbered(rows.withColumn("neg", -F.col("score")), ["job"], ["neg", "node"], "rank", 1), "ranks")
    valid = numbered(ranks.where("score % 2 = 1").select("job", "rank"), ["job"], ["rank"], "nth", 1)
    last = valid.where("nth = 5").select("job", F.col("rank").alias("last"))
    return ranks.join(F.broadcast(last), "job", "left").where("last is null or rank <= last").select("job", "node", "score", "rank")


@query("SELECT n.node, p_brand AS sub_class FROM nodes n JOIN part ON p_partkey = n.node WHERE n.graph = 'A' AND p_brand IN ('Brand#11', 'Brand#22')")
def property_highlight(spark, d):
    marked = annotations(spark, d).where(F.col("sub_class").isin("Brand#11", "Brand#22")).select("node", "sub_class")
    return g.nodes_of(edges_of(spark, d, "A")).join(marked, "node")


@query("SELECT p_partkey::BIGINT AS node, regexp_replace(p_type || ' / ' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM part")
def safe_names(spark, d):
    return annotations(spark, d).select("node", t.safe_name(F.concat_ws(" / ", "primary_type", "sub_class")).alias("safe"))


@query("SELECT degree AS pivot FROM (SELECT degree, row_number() OVER (ORDER BY degree, node) - 1 AS i, count(*) OVER () AS n FROM (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ea UNION ALL SELECT dst FROM ea) GROUP BY node)) WHERE i = floor((n - 1) * 0.35)")
def degree_band_pivot(spark, d):
    return spark.createDataFrame([(sample.lower_quantile(g.total_degree(edges_of(spark, d, "A")), 0.35),)], "pivot long")


@query(None)
def independent_set(spark, d):
    return sample.best_independent_set(edges_of(spark, d, "A"))


@query("SELECT 0::BIGINT AS violations, 0::BIGINT AS uncovered")
def independent_set_violations(spark, d):
    """Edges within the set, and nodes that could still join it."""
    e = stage(edges_of(spark, d, "A"), "edges")
    chosen = stage(sample.best_independent_set(e), "chosen")
    near = sample.neighbours(e).join(chosen.select(F.col("node").alias("other")), "other").select("node").distinct()
    inside = near.join(chosen, "node", "left_semi").agg(F.count("*").alias("violations"))
    free = g.nodes_of(e).join(chosen, "node", "left_anti").join(near, "node", "left_anti").agg(F.count("*").alias("uncovered"))
    return inside.join(free)


def _job_sample(spark, d, graph):
    e = stage(edges_of(spark, d, graph), "edges")
    return g.without_loops(g.induced(e, sample.bfs_sample(e, JOB_SAMPLE, sample.high_first()).select("node")))


def _pair(spark, d):
    jobs = mcs.edge_list(_job_sample(spark, d, "A"), "left_edges").join(mcs.edge_list(_job_sample(spark, d, "N"), "right_edges"))
    return stage(mcs.solve_jobs(jobs.select(F.lit("A-N").alias("job"), "*")), "incumbents")


@query(None)
def pair_mcis(spark, d):
    """Incumbents of the pair of samples of graphs A and N."""
    return _pair(spark, d).select("job", "ordinal", "size", "complete", "error")


@query(None)
def threeway_mcis(spark, d):
    """Rows (pos, a, n, r): the best mapping of A and N, induced in A, matched with a sample of R."""
    pair = mcs.best_mapping(_pair(spark, d))
    pattern = g.induced(edges_of(spark, d, "A"), pair.select(F.col("l").alias("node")))
    jobs = mcs.edge_list(g.without_loops(pattern), "left_edges").join(mcs.edge_list(_job_sample(spark, d, "R"), "right_edges"))
    third = mcs.best_mapping(mcs.solve_jobs(jobs.select(F.lit("A-R").alias("job"), "*")))
    return third.select("pos", "l", F.col("r").alias("third")).join(pair.select("l", F.col("r").alias("n")), "l").select("pos", F.col("l").alias("a"), "n", F.col("third").alias("r"))


@query(None)
def sample_high_degree_bfs(spark, d):
    return sample.bfs_sample(edges_of(spark, d, "A"), SAMPLE, sample.high_first())


@query(None)
def sample_low_degree_bfs(spark, d):
    return sample.bfs_sample(edges_of(spark, d, "A"), SAMPLE, sample.low_first())


@query(None)
def sample_random_bfs(spark, d):
    return sample.bfs_sample(edges_of(spark, d, "A"), SAMPLE, sample.hashed(1))


@query(None)
def sample_degree_band_bfs(spark, d):
    e = edges_of(spark, d, "A")
    return sample.bfs_sample(e, SAMPLE, sample.band_first(sample.lower_quantile(g.total_degree(e), 0.35)))


@query(None)
def sample_sparse_greedy(spark, d):
    return sample.sparse_sample(edges_of(spark, d, "A"), SAMPLE)


@query(None)
def sample_random_nodes(spark, d):
    return sample.first_nodes(edges_of(spark, d, "A"), SAMPLE, sample.hashed(1))
