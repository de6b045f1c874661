"""Registered queries that go through files: tables are written to the shared folder in the formats that are read, then scanned."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import common_subgraph as mcs
from skein.operators import graph as g
from skein.operators import patterns as pt
from skein.operators import sampling as sample
from skein.plans.numbering import numbered
from skein.plans.staging import shared_dir, stage
from skein.queries import _nodeset, query
from skein.sinks import tables as out
from skein.sinks import text as lines_of
from skein.sources import files, pages
from skein.sources.edges import annotations, edges_of, read_edge_list, read_mapping, read_node_list, succession


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


def _one_file(lines: list[str], spark: SparkSession, path: str) -> str:
    """A small file of fixed lines."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def _edge_file(spark, d) -> str:
    rows = succession(spark, d).where("graph = 'A'").select(F.col("src").alias(files.SOURCE), F.col("dst").alias(files.TARGET))
    return _csv(rows, _folder(spark))


_A_ROWS = "SELECT src, dst FROM rows1 WHERE graph = 'A'"


@query(_A_ROWS)
def csv_edges(spark, d):
    return read_edge_list(spark, _edge_file(spark, d))


@query(_A_ROWS)
def csv_edges_strict(spark, d):
    return files.strict_edges(spark, _edge_file(spark, d))


@query(f"SELECT a AS src, b AS dst, count(*) AS n FROM (SELECT src AS a, dst AS b FROM ({_A_ROWS})) GROUP BY ALL")
def csv_edges_by_position(spark, d):
    """First two cells of wider rows; short lines and headers are skipped."""
    rows = succession(spark, d).where("graph = 'A'").select(F.concat_ws(",", "src", "dst", "syn_count", "neuropil").alias("value"))
    odd = spark.createDataFrame([(0, "a,b,c,d"), (2, "17"), (2, "")], "turn int, value string")
    at = _folder(spark)
    rows.select(F.lit(1).alias("turn"), "value").unionByName(odd).orderBy("turn").coalesce(1).select("value").write.text(at)  # one file: its first line is its header
    return files.tolerant_edges(spark, at).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT src, dst, forward FROM (SELECT src, dst, true AS forward FROM ea UNION ALL SELECT dst, src, false FROM ea)")
def edges_both_ways(spark, d):
    return files.both_ways(edges_of(spark, d, "A"))


@query("SELECT node, other FROM (SELECT src AS node, dst AS other FROM ea WHERE src <> dst UNION SELECT dst, src FROM ea WHERE src <> dst)")
def undirected_projection(spark, d):
    return sample.neighbours(edges_of(spark, d, "A"))


@query("SELECT row_number() OVER (ORDER BY src, dst) - 1 AS idx, src, dst FROM ea")
def sorted_edges(spark, d):
    return numbered(edges_of(spark, d, "A"), [], ["src", "dst"])


@query("SELECT node FROM nodeset")
def node_list_scan(spark, d):
    at = _folder(spark)
    _nodeset(spark, d).select(F.concat(F.lit(" "), F.col("node").cast("string")).alias("value")).unionByName(spark.createDataFrame([("",), ("  ",)], "value string")).write.text(at)
    return read_node_list(spark, at)


def _mapping_file(spark, d) -> str:
    """Places of the common nodes: A and N by id, R from the greatest; one part, so rows stand in their order."""
    from skein.queries import common_nodes

    m = stage(numbered(common_nodes(spark, d), [], ["node"], "pos"), "places")
    n = m.agg(F.count("*").alias("n"))
    back = m.join(F.broadcast(n)).select((F.col("n") - 1 - F.col("pos")).alias("pos"), F.col("node").alias("r"))
    wide = m.join(back, "pos").orderBy("pos").select(F.col("node").alias("A"), (F.col("node") + 1).alias("N"), F.when(F.col("r") % 50 == 0, "none").otherwise(F.col("r").cast("string")).alias("R"))
    return _csv(wide.coalesce(1), _folder(spark))


_PLACES = """p AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS pos, count(*) OVER () AS n FROM (SELECT node FROM nodes GROUP BY node HAVING count(DISTINCT graph) = 3)),
w AS (SELECT a.pos, a.node AS a, a.node + 1 AS n, CASE WHEN b.node % 50 <> 0 THEN b.node END AS r FROM p a JOIN p b ON b.pos = a.n - 1 - a.pos)"""


def _wrap(ctes: str, body: str) -> str:
    return f"SELECT * FROM (WITH {ctes}\n{body})"


@query(_wrap(_PLACES, "SELECT pos, 'A' AS graph, a AS node FROM w UNION ALL SELECT pos, 'N', n FROM w UNION ALL SELECT pos, 'R', r FROM w"))
def threeway_mapping_scan(spark, d):
    return files.mapping_places(spark, _mapping_file(spark, d), 3)


@query(_wrap(_PLACES, "SELECT pos, 'A' AS graph, a AS node FROM w UNION ALL SELECT pos, 'N', n FROM w"))
def pair_mapping_scan(spark, d):
    return read_mapping(spark, _mapping_file(spark, d))


@query(_wrap(_PLACES, "SELECT pos, n AS node FROM w"))
def mapping_side(spark, d):
    return files.one_side(files.mapping_places(spark, _mapping_file(spark, d), 2), "N")


@query("SELECT idx, node FROM (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM nodes WHERE graph = 'A')")
def index_map_scan(spark, d):
    index = numbered(g.nodes_of(edges_of(spark, d, "A")), [], ["node"])
    return files.index_map(spark, _csv(index.select(F.col("idx").alias("symsplit_index"), F.col("node").alias("node_id")), _folder(spark)))


@query("SELECT count(*) AS nodes, max(node) AS greatest, 'A' AS graph FROM nodes WHERE graph = 'A'")
def metadata_scan(spark, d):
    one = g.nodes_of(edges_of(spark, d, "A")).agg(F.count("*").alias("nodes"), F.max("node").alias("greatest"), F.lit("A").alias("graph"))
    at = _one_file(out.summary_json(one).split("\n"), spark, _folder(spark))
    return files.metadata(spark, at).select("nodes", "greatest", "graph")


_SIZES = "sizes AS (SELECT graph, p_size AS component_id, count(*) AS size FROM nodes JOIN part ON p_partkey = node GROUP BY ALL)"


def _component_files(spark, d) -> str:
    at = _folder(spark)
    sizes = stage(g.nodes_of(edges_of(spark, d), "graph").join(annotations(spark, d), "node").groupBy("graph", F.col("size").alias("component_id")).agg(F.count("*").alias("size")), "sizes")
    for name in ("A", "N", "R"):
        part = f"{at}/deep/{name}"
        sizes.where(F.col("graph") == name).select("component_id", "size").coalesce(1).write.option("header", True).csv(part)
        _rename_part(spark, part, f"{at}/components/{name}.wcc_components.csv")
    return at


def _rename_part(spark: SparkSession, folder: str, to: str) -> None:
    """The one part of a folder under a file name of its own, moved within the store that holds it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = path(to)
    fs.mkdirs(target.getParent())
    for status in fs.listStatus(path(folder)):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), target)
    fs.delete(path(folder), True)


@query(_wrap(_SIZES, "SELECT graph, component_id::BIGINT AS component_id, size FROM sizes WHERE size >= 35"))
def large_components(spark, d):
    return files.large_components(spark, _component_files(spark, d) + "/components", 35)


@query(_wrap(_SIZES, "SELECT graph, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, graph) AS place FROM sizes GROUP BY graph ORDER BY rows DESC, graph LIMIT 2"))
def largest_files(spark, d):
    """Files found below a folder by their ending, with their rows; the two with the most."""
    found = files.found_files(spark, _component_files(spark, d), ".wcc_components.csv")
    named = found.select(F.regexp_extract("file", r"([^/]+)\.wcc_components\.csv$", 1).alias("graph"), "rows", (-F.col("rows")).alias("neg"))
    return numbered(named, [], ["neg", "graph"], "place", 1).where("place <= 2").drop("neg")


@query("SELECT node FROM nodes JOIN part ON p_partkey = node WHERE graph = 'A' AND p_size = 7")
def component_members(spark, d):
    rows = g.nodes_of(edges_of(spark, d, "A")).join(annotations(spark, d), "node").select(F.col("node").alias("node_id"), F.col("size").alias("component_id"))
    return files.component_nodes(rows, 7)


@query("SELECT node, p_type AS primary_type FROM nodeset JOIN part ON p_partkey = node")
def renamed_types(spark, d):
    """Two columns of a wide annotation table, renamed at the scan; back-ticks keep odd names."""
    a = annotations(spark, d).select(F.col("node").alias("Root ID"), F.col("primary_type").alias("Primary Cell Type"), F.col("sub_class").alias("Alternative Cell Type(s)"))
    types = a.select(F.col("`Root ID`").alias("node"), F.col("`Primary Cell Type`").alias("primary_type"))
    return _nodeset(spark, d).join(types, "node")


@query("SELECT 'part' AS kind, count(*) AS rows, max(p_size)::BIGINT AS most FROM part")
def run_bundle(spark, d):
    """A run's folder: a table and its summary, tagged by the folder's name."""
    at = _folder(spark)
    a = annotations(spark, d)
    _csv(a.select("node", "size"), f"{at}/rows.csv")
    _one_file([json.dumps({"most": a.agg(F.max("size")).first()[0]})], spark, f"{at}/summary.json")
    found = files.run_bundle(spark, at, {"rows": "rows.csv", "summary": "summary.json"})
    return found["rows"].groupBy("run_name").agg(F.count("*").alias("rows")).join(found["summary"], "run_name").select(F.lit("part").alias("kind"), "rows", F.col("most").cast("long").alias("most"))


#: Two pages as browsers show them: tables and charts, rows of three cells and of one.
_PAGE = '<table><tr><th>Type</th><th>n</th></tr><tr><td>Kenyon <b>cell</b></td><td>1,204</td></tr><tr></tr></table><p>x</p><table><tr><td>only</td></tr></table>'
_SCRIPT = '<script>chart_json = {"type": "big_number", "label": "Neurons", "value": "1,204", "color": "red"};\n elem = document.createElement("p");</script><script>chart_json = {"type": "bar", "data": [["Side", "n"], ["left", 3]]}; elem = document.createElement</script>'


@query("""SELECT * FROM (VALUES (1::BIGINT, 'Table 1', 0, 0, 'Type|n'), (1, 'Table 1', 0, 1, 'Kenyon cell|1,204'), (1, 'Table 2', 1, 0, 'only')) t(page_id, label, table_idx, row_idx, cells)""")
def html_tables(spark, d):
    rows = pages.html_tables(spark.createDataFrame([(1, _PAGE), (2, ""), (3, None)], "page_id long, html string"), "page_id", "html")
    return rows.withColumn("cells", F.array_join("cells", "|"))


@query("""SELECT * FROM (VALUES (1::BIGINT, 0, 'Neurons', 'big_number', 'red', 'Neurons', '1,204', NULL), (1, 1, 'Side', 'bar', NULL, NULL, NULL, '[["Side","n"],["left",3]]')) t(page_id, idx, title, chart_type, color, label, value, data)""")
def html_charts(spark, d):
    return pages.html_charts(spark.createDataFrame([(1, _SCRIPT), (2, None)], "page_id long, html string"), "page_id", "html")


@query("SELECT page_id, 0::BIGINT AS tables FROM pages")
def page_tables(spark, d):
    """Tables of every page: the crawled ones have none."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    found = pages.html_tables(p, "page_id", "html").groupBy("page_id").agg(F.count("*").alias("tables"))
    return p.select("page_id").join(found, "page_id", "left").na.fill(0, ["tables"])


_KAHIP = "u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ea WHERE src <> dst), ix AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM nodes WHERE graph = 'A')"


@query(_wrap(_KAHIP, "SELECT coalesce(string_agg(j::VARCHAR, ' ' ORDER BY j), '') AS value, i AS line FROM (SELECT x.i, y.i AS j FROM (SELECT a, b FROM u UNION ALL SELECT b, a FROM u) e JOIN ix x ON x.node = e.a JOIN ix y ON y.node = e.b UNION ALL SELECT i, NULL FROM ix) GROUP BY i UNION ALL SELECT (SELECT count(*) FROM ix) || ' ' || (SELECT count(*) FROM u), 0"))
def kahip_lines(spark, d):
    """A node's line is its neighbours' places; read back from text with its line numbers."""
    at = _folder(spark)
    lines_of.write_lines(lines_of.kahip_lines(edges_of(spark, d, "A"))[0].coalesce(1), at)
    return files.numbered_lines(spark, at).select((F.col("line_no") - 1).alias("line"), "value")


@query(_wrap(_KAHIP, "SELECT (SELECT count(*) FROM ix) AS nodes, (SELECT count(*) FROM u) AS edges"))
def kahip_header(spark, d):
    at = _folder(spark)
    lines_of.write_lines(lines_of.kahip_lines(edges_of(spark, d, "A"))[0].coalesce(1), at)
    return files.header_numbers(files.numbered_lines(spark, at))


@query("SELECT node FROM (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM nodes WHERE graph = 'A') WHERE idx % 3 = 0")
def selected_nodes(spark, d):
    """A membership vector, a line a node, as a solver leaves it: 1, true or True."""
    index = stage(numbered(g.nodes_of(edges_of(spark, d, "A")), [], ["node"]), "index")
    word = F.when(F.col("idx") % 9 == 0, "1").when(F.col("idx") % 9 == 3, "true").when(F.col("idx") % 9 == 6, "True").otherwise("0")
    at = _folder(spark)
    index.orderBy("idx").select(word.alias("value")).coalesce(1).write.text(at)
    return files.selected(files.numbered_lines(spark, at), index)


_DIMACS = "ind AS (SELECT src, dst FROM ea WHERE src IN (SELECT node FROM nodeset) AND dst IN (SELECT node FROM nodeset)), ix AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM (SELECT src AS node FROM ind UNION SELECT dst FROM ind))"


@query(_wrap(_DIMACS, "SELECT 'e ' || x.i || ' ' || y.i AS value FROM ind JOIN ix x ON x.node = src JOIN ix y ON y.node = dst UNION ALL SELECT 'p edge ' || (SELECT count(*) FROM ix) || ' ' || (SELECT count(*) FROM ind)"))
def pattern_dimacs(spark, d):
    """An induced pattern written as CSV, DIMACS and map, the lines read back."""
    at = _folder(spark)
    out.write_pattern(stage(g.induced(edges_of(spark, d, "A"), _nodeset(spark, d)), "pattern"), at)
    return spark.read.text(f"{at}/pattern.dimacs")


@query("SELECT pos, l, r FROM (SELECT pos, CASE WHEN pos % 10 <> 7 THEN node END AS l, node AS r FROM (SELECT node, row_number() OVER (ORDER BY node) - 1 AS pos FROM nodes WHERE graph = 'A')) WHERE l IS NOT NULL")
def mapped_pairs(spark, d):
    """Places as nodes; places out of range are left out."""
    index = stage(numbered(g.nodes_of(edges_of(spark, d, "A")), [], ["node"]), "index")
    pairs = index.select(F.col("idx").alias("pos"), F.when(F.col("idx") % 10 == 7, F.col("idx") + 10_000_000).otherwise(F.col("idx")).alias("li"), F.col("idx").alias("ri"))
    return out.mapped_nodes(pairs, index, index)[0]


@query("SELECT l.graph AS heldout, l.size::BIGINT AS size, l.nodes FROM (SELECT graph, 10 AS size, count(*) AS nodes FROM nodes GROUP BY graph) l")
def catalogued_jobs(spark, d):
    """Samples found by their keys instead of by paths."""
    samples = g.nodes_of(edges_of(spark, d), "graph").groupBy(F.col("graph").alias("heldout"), F.lit(10).cast("long").alias("size")).agg(F.count("*").alias("nodes"))
    jobs = samples.select("heldout", "size").distinct()
    return files.catalogued(jobs, samples, "heldout", "size")


# --- samplers, sets and solver against what must hold of them ---

SIZE = 40


@query("SELECT * FROM (VALUES ('high', 40::BIGINT, 0::BIGINT, 0::BIGINT), ('low', 40, 0, 0), ('random_bfs', 40, 0, 0), ('band', 40, 0, 0), ('sparse', 40, 0, 0), ('nodes', 40, 0, 0)) t(sampler, size, foreign_nodes, repeated)")
def sampler_checks(spark, d):
    """Every sampler's size, nodes that aren't the graph's, and repeats."""
    e = stage(edges_of(spark, d, "A"), "edges")
    band = sample.lower_quantile(g.total_degree(e), 0.35)
    made = {"high": sample.bfs_sample(e, SIZE, sample.high_first()), "low": sample.bfs_sample(e, SIZE, sample.low_first()), "random_bfs": sample.bfs_sample(e, SIZE, sample.hashed(1)), "band": sample.bfs_sample(e, SIZE, sample.band_first(band)), "sparse": sample.sparse_sample(e, SIZE), "nodes": sample.first_nodes(e, SIZE, sample.hashed(1))}
    rows = None
    for name, nodes in made.items():
        part = nodes.select(F.lit(name).alias("sampler"), "node")
        rows = part if rows is None else rows.unionByName(part)
    known = g.nodes_of(e).withColumn("known", F.lit(True))
    return rows.join(known, "node", "left").groupBy("sampler").agg(F.count("*").alias("size"), F.count_if(F.col("known").isNull()).alias("foreign_nodes"), (F.count("*") - F.count_distinct("node")).alias("repeated"))


@query("SELECT * FROM (VALUES (0::BIGINT, true)) t(edges_inside, side_by_side)")
def edgeless_match(spark, d):
    """Independent sets of the three graphs laid side by side: no edge inside, as many places in each."""
    e = stage(edges_of(spark, d), "edges")
    sets = None
    for name in ("A", "N", "R"):
        part = sample.best_independent_set(e.where(F.col("graph") == name).select("src", "dst"), 2).select(F.lit(name).alias("graph"), "node")
        sets = part if sets is None else sets.unionByName(part)
    match = stage(pt.edgeless_match(stage(sets, "sets")), "match")
    ends = match.select("graph", F.col("node").alias("src")), match.select("graph", F.col("node").alias("dst"))
    inside = g.without_loops(e).join(ends[0], ["graph", "src"], "left_semi").join(ends[1], ["graph", "dst"], "left_semi").agg(F.count("*").alias("edges_inside"))
    sides = match.groupBy("pos").agg(F.count("*").alias("n")).agg((F.count_if(F.col("n") != 3) == 0).alias("side_by_side"))
    return inside.join(sides)


def _planted(spark, d, rename: int) -> tuple[DataFrame, DataFrame]:
    e = stage(edges_of(spark, d, "A"), "edges")
    some = stage(g.without_loops(g.induced(e, sample.bfs_sample(e, 30, sample.high_first()).select("node"))), "sample")
    return some, some.select((F.col("src") * 3 + rename).alias("src"), (F.col("dst") * 3 + rename).alias("dst"))


@query("SELECT 'copy' AS job, true AS whole, 0::BIGINT AS missing, 0::BIGINT AS extra")
def planted_mcis(spark, d):
    """A sample and a copy of it with other ids: the solver must map all of it, and the mapping must hold."""
    from skein.operators.verification import verify_pairs

    left, right = _planted(spark, d, 11)
    jobs = mcs.edge_list(left, "left_edges").join(mcs.edge_list(right, "right_edges")).select(F.lit("copy").alias("job"), "*")
    best = stage(mcs.best_mapping(mcs.solve_jobs(jobs)), "best")
    graphs = left.select(F.lit("l").alias("graph"), "*").unionByName(right.select(F.lit("r").alias("graph"), "*"))
    pairs = best.select(F.col("job").alias("mapping"), "pos", F.lit("l").alias("left_graph"), F.lit("r").alias("right_graph"), "l", "r")
    n = g.nodes_of(left).agg(F.count("*").alias("n"))
    found = verify_pairs(pairs, graphs, loops=False).join(F.broadcast(n))
    return found.select(F.col("mapping").alias("job"), (F.col("nodes") == F.col("n")).alias("whole"), "missing", "extra")


@query("SELECT 'copies' AS job, true AS whole, 3::BIGINT AS graphs, true AS isomorphic")
def planted_many(spark, d):
    """Three copies of a sample: the match of the first two is searched in the third, and all of it is found."""
    from skein.operators.verification import verify_many

    first, second = _planted(spark, d, 11)
    third = _planted(spark, d, 500)[1]
    corr = stage(mcs.match_many([("a", first), ("b", second), ("c", third)]), "corr")
    graphs = None
    for name, e in (("a", first), ("b", second), ("c", third)):
        part = e.select(F.lit(name).alias("graph"), "src", "dst")
        graphs = part if graphs is None else graphs.unionByName(part)
    n = g.nodes_of(first).agg(F.count("*").alias("n"))
    done = verify_many(corr.select(F.lit("copies").alias("mapping"), "pos", F.col("graph").alias("side"), "graph", "node"), graphs, ["a", "b", "c"]).join(F.broadcast(n))
    return done.select(F.col("mapping").alias("job"), (F.col("nodes") == F.col("n")).alias("whole"), F.lit(3).cast("long").alias("graphs"), "isomorphic")


@query("SELECT 'A' AS pattern, 'copy' AS third, true AS present")
def third_graph_match(spark, d):
    """A pattern searched in a third graph: present if the match has all its nodes."""
    left, right = _planted(spark, d, 77)
    jobs = mcs.edge_list(left, "left_edges").join(mcs.edge_list(right, "right_edges")).select(F.lit("copy").alias("job"), "*")
    size = mcs.best_mapping(mcs.solve_jobs(jobs)).agg(F.count("*").alias("size"))
    n = g.nodes_of(left).agg(F.count("*").alias("n"))
    return size.join(n).select(F.lit("A").alias("pattern"), F.lit("copy").alias("third"), (F.col("size") == F.col("n")).alias("present"))
