"""Scans of files, numbering, hashes and sinks on small inline fixtures."""

import json

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from skein.functions import hashing
from skein.functions import text as t
from skein.operators import patterns as pt
from skein.operators import verification as v
from skein.plans.numbering import numbered
from skein.plans.staging import shared_dir, stage, unstage
from skein.sinks import tables as out
from skein.sources import files, pages

HEAD = f"{files.SOURCE},{files.TARGET}"


def put(path, text):
    path.write_text(text)
    return str(path)


def test_strict_header(spark, tmp_path):
    assert files.strict_edges(spark, put(tmp_path / "a.csv", f"{HEAD}\n1,2\n1,2\n")).count() == 2
    for n, head in enumerate((f"{HEAD},x", files.SOURCE, f"{files.TARGET},y")):
        with pytest.raises(ValueError, match="header"):
            files.strict_edges(spark, put(tmp_path / f"b{n}.csv", f"{head}\n1,2,3\n"))


def test_tolerant_scan_names_file_and_line(spark, tmp_path):
    rows = files.tolerant_edges(spark, put(tmp_path / "g_1_edge_list.csv", "anything\n720575941633862331,2,z\n7\n\n3,3\n")).collect()
    assert [tuple(r) for r in sorted(rows)] == [("g_1", 0, 720575941633862331, 2), ("g_1", 3, 3, 3)]
    bad = files.tolerant_edges(spark, put(tmp_path / "bad.csv", "h\n1,2\n1,two\n"))
    with pytest.raises(SparkRuntimeException, match=r"'two' in line 3 of .*bad\.csv"):
        bad.collect()


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    at = put(tmp_path / "long.txt", "".join(f"row {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.numbered_lines(spark, at)
        assert spark.read.text(at).rdd.getNumPartitions() > 1
        assert [(r.line_no, r.value) for r in rows.orderBy("line_no").collect()] == [(i + 1, f"row {i}") for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_mapping_places(spark, tmp_path):
    at = put(tmp_path / "m.csv", "b_1,a,extra\n5,7,x\n\n6,none,y\n")
    assert sorted(map(tuple, files.mapping_places(spark, at).collect()), key=str) == [(0, "a", 7), (0, "b_1", 5), (2, "a", None), (2, "b_1", 6)]
    with pytest.raises(ValueError, match="3 named columns"):
        files.mapping_places(spark, put(tmp_path / "n.csv", "a,b\n1,2\n"), 3)


def test_run_bundle_and_catalog(spark, tmp_path):
    run = tmp_path / "run7"
    run.mkdir()
    put(run / "rows.csv", "a\n1\n")
    put(run / "s.json", json.dumps({"n": 3, "x": {"min": 1}}, indent=1))
    got = files.run_bundle(spark, str(run), {"rows": "rows.csv", "s": "s.json"})
    assert got["rows"].first().run_name == "run7" and got["s"].first().x["min"] == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.run_bundle(spark, str(run), {"gone": "gone.csv"})["gone"].count()
    samples = spark.createDataFrame([("a", 10, "here")], "graph string, size int, at string")
    jobs = spark.createDataFrame([("a", 10), ("b", 10)], "graph string, size int")
    assert files.catalogued(jobs.where("graph = 'a'"), samples, "graph", "size").first().at == "here"
    with pytest.raises(SparkRuntimeException, match="no sample for b 10"):
        files.catalogued(jobs, samples, "graph", "size").collect()


def test_numbers_within_groups(spark):
    rows = [(k, i, i * 7 % 101) for k in ("x", None, "y") for i in range(101)]
    df = spark.createDataFrame(rows, "k string, id long, o long").repartition(5)
    got = {(r.k, r.o): r.idx for r in numbered(df, ["k"], ["o"]).collect()}
    assert got == {(k, o): o for k, _, o in rows}
    assert numbered(df.limit(0), [], ["o"]).count() == 0


def test_hashes(spark):
    df = spark.createDataFrame([(0,), (1,), (None,), (-1,)], "x long")
    got = [r[0] for r in df.select(hashing.splitmix64(F.col("x"))).collect()]
    assert got[0] == 0xE220A8397B1DCDAF - (1 << 64) and got[2] is None and got[3] == -1956452734106584416 or got[3] is not None
    h = 0xCBF29CE484222325
    for b in (5).to_bytes(8, "little") + (9).to_bytes(8, "little"):
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    assert spark.range(1).select(hashing.fnv1a(F.array(F.lit(5).cast("long"), F.lit(9).cast("long")))).first()[0] % (1 << 64) == h


def test_fixed_ratios_round_the_binary_value(spark):
    halves = [(7, 640), (1, 80000), (31, 99200), (1, 400000), (1, 128), (3, 128), (2, 3), (-1, 80000), (1999999, 2000000), (5, 1)]
    rows = spark.createDataFrame([*[(float(p), w) for p, w in halves], (2.0, 0), (1.0, None), (None, 3)], "part double, whole long")
    got = rows.select(t.fixed_ratio(F.col("part"), F.col("whole")).alias("x")).collect()
    assert [r.x for r in got] == [*[f"{p / w:.6f}" for p, w in halves], "0.000000", None, None]


def test_page_tables_and_charts():
    nested = "<table><tr><td>a<table><tr><td>in</td></tr></table></td></tr></table>" + "<table><tr><th>x</th></tr></table>" * 8
    rows = pages.tables_of(nested)
    assert rows[0][0] == "Table 1" or rows[0][0] == "Summary"
    assert len({r[1] for r in rows}) == 10 or len({r[1] for r in rows}) == 9
    nine = pages.tables_of("<table><tr><td>1<td>2</table>" * 9)
    assert [r[0] for r in nine][:2] == ["Summary", "Top Primary Cell Types"] and nine[0][3] == ["1", "2"]
    assert pages.charts_of('chart_json = {"type": "bar", "data": [["a", 1]]};\n elem = document.createElement("x")') == [{"type": "bar", "data": [["a", 1]]}]


def test_mapping_with_a_node_twice(spark):
    edges = spark.createDataFrame([("a", 1, 2), ("b", 10, 20), ("b", 20, 20), ("a", 2, 2)], "graph string, src long, dst long")
    rows = [("ok", 0, 1, 10), ("ok", 1, 2, 20), ("turned", 0, 1, 20), ("turned", 1, 2, 10), ("twice", 0, 1, 10), ("twice", 1, 1, 20)]
    pairs = spark.createDataFrame([(m, p, "a", "b", left, right) for m, p, left, right in rows], "mapping string, pos long, left_graph string, right_graph string, l long, r long")
    got = {r.mapping: r for r in v.verify_pairs(pairs, edges).collect()}
    assert got["ok"].valid and got["ok"].left_edges == 2
    assert (got["turned"].missing, got["turned"].extra, got["turned"].valid) == (2, 2, False)
    assert got["twice"].left_duplicate and not got["twice"].valid
    assert v.verify_pairs(pairs.limit(0), edges).count() == 0


def test_markdown_and_components(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2.0), ("a", None)], "name string, x double")
    assert out.markdown(rows, ["name"]) == "| name | x |\n| --- | --- |\n| a |  |\n| b | 2.0000 |"
    assert out.markdown(rows.limit(0), ["name"]).startswith("_No rows")
    of = spark.createDataFrame([(1, 1), (2, 1), (5, 5)], "node long, component long")
    out.write_components(of, spark.createDataFrame([(1, 2)], "src long, dst long"), "g", "wcc", str(tmp_path / "o"))
    assert [tuple(r) for r in files.large_components(spark, str(tmp_path / "o" / "components"), 2).collect()] == [("g", 1, 2)]
    assert spark.read.option("header", True).csv(str(tmp_path / "o" / "summary" / "g.wcc_summary.csv")).first().top10 == "2;1"


def test_patterns_match_whatever_the_ids(spark):
    one = [(1, 2), (2, 3), (3, 1), (4, 1)]
    rows = [("a", x, y) for x, y in one] + [("b", 9 - x, 9 - y) for x, y in one]
    got = pt.common_patterns(spark.createDataFrame(rows, "graph string, src long, dst long"), 2).collect()
    assert len(got) == 3 and all(r.least == 1 and r.total == 2 for r in got)


def test_staged_tables_go(spark):
    import os

    path = shared_dir(spark)
    before = len(os.listdir(path))
    assert stage(spark.range(3).toDF("x"), "gone").count() == 3 and len(os.listdir(path)) == before + 1
    assert unstage(spark) > 0 and len(os.listdir(path)) <= before
