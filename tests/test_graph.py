import random

import duckdb
import pytest

import __spark_entry__
from skein.operators import components as c
from skein.operators import graph as g
from skein.sources import edges as s
from skein.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(SQL[name])
    got = QUERIES[name](spark, SF).select(*rel.columns).collect()
    form = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert form(got) == form(rel.fetchall())


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("bound", [0, 10**6])
def test_components_both_ways(spark, monkeypatch, bound):
    monkeypatch.setattr(c, "ONE_TASK", bound)
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in c.components(df).collect()}
    assert got == brute(edges)


def test_components_of_nothing(spark):
    assert c.components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert c.components(spark.createDataFrame([(None, 1)], "src long, dst long")).count() == 0


def test_positions_and_pairs(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (2, 3)], "src long, dst long")
    m = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "pos long, node long")
    assert sorted(map(tuple, g.positional(e, m).collect())) == [(2, 1)]
    other = spark.createDataFrame([(2, 3), (3, 1)], "src long, dst long")
    assert sorted((r.src, r.dst, r.status) for r in g.pair_difference(e, other).collect()) == [(1, 2, "missing"), (3, 1, "extra")]


def test_scans(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source neuron id,target neuron id\n1,2\n1,2\n3,3\n")
    assert s.read_edge_list(spark, str(tmp_path / "e.csv")).count() == 3
    with pytest.raises(ValueError):
        s.read_edge_list(spark, str(tmp_path / "e.csv"), src="absent")
    (tmp_path / "n.txt").write_text("5\n\n 7 \n")
    assert sorted(r.node for r in s.read_node_list(spark, str(tmp_path / "n.txt")).collect()) == [5, 7]
    (tmp_path / "m.csv").write_text("a,b,i\n1,9,0\n2,x,1\n")
    assert sorted((r.graph, r.node) for r in s.read_mapping(spark, str(tmp_path / "m.csv")).collect() if r.node) == [("a", 1), ("a", 2), ("b", 9)]
