"""The command line from edge files to result folders."""

import random

import pytest

from skein import cli
from skein.sources.files import SOURCE, TARGET


@pytest.fixture(scope="module")
def graphs(tmp_path_factory):
    at = tmp_path_factory.mktemp("raw")
    r = random.Random(1)
    edges = sorted({(r.randrange(14), r.randrange(14)) for _ in range(40)})
    paths = []
    for k, name in enumerate("abc"):
        file = at / f"{name}_edge_list.csv"
        file.write_text(f"{SOURCE},{TARGET}\n" + "".join(f"{x * 10 + k},{y * 10 + k}\n" for x, y in edges))
        paths.append(str(file))
    return paths


def run(spark, *args):
    cli.run(spark, cli.parser().parse_args(list(args)))


def test_threeway_of_copies(spark, graphs, tmp_path):
    run(spark, "threeway", *graphs, "--out", str(tmp_path / "o"), "--sizes", "12", "--jobs", "2")
    row = spark.read.option("header", True).csv(str(tmp_path / "o" / "detail")).first()
    assert row.isomorphic == "true" and row.nodes == "12" and row.mapping == "a-b-c"
    assert spark.read.text(str(tmp_path / "o" / "nodes_c")).count() == 12
    run(spark, "runs", "--runs", str(tmp_path / "o"), "--out", str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "run_summary")).where("metric = 'nodes'").first().max == "12.0"
    wide = tmp_path / "m.csv"
    wide.write_text("a,b\n" + "".join(f"{10 * i},{10 * i + 1}\n" for i in range(14)))
    run(spark, "verify", *graphs[:2], "--mapping", str(wide), "--out", str(tmp_path / "v"))
    assert spark.read.option("header", True).csv(str(tmp_path / "v" / "verified")).first().iso_a_b == "true"


@pytest.mark.parametrize("strategy", cli.STRATEGIES)
def test_pairwise(spark, graphs, tmp_path, strategy):
    best, checked = cli.pairwise(cli.graphs_of(spark, graphs[:2]), strategy, [10], 2)
    row = checked.first()
    assert row.valid and row.nodes == best.count() and row.error is None


def test_components_patterns_and_the_rest(spark, graphs, tmp_path):
    for command in ("weak", "strong", "component-pairs", "many", "patterns", "independent-set", "hubs", "report", "smoke", "sample"):
        run(spark, command, *graphs[:2], "--out", str(tmp_path / command), "--sizes", "9", "--least", "1")
    assert spark.read.option("header", True).csv(str(tmp_path / "many" / "mapping")).count() == 14
    assert spark.read.option("header", True).csv(str(tmp_path / "component-pairs" / "matches")).where("error is null").count() >= 1
    with pytest.raises(ValueError, match="more than 3 nodes"):
        run(spark, "many", *graphs, "--max-nodes", "3")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["nothing"])


def test_tables_of_types_modules_and_stored_rows(spark, graphs, tmp_path):
    put = lambda name, text: str((tmp_path / name).write_text(text) and tmp_path / name)
    run(spark, "outdegree", graphs[0], "--table", put("t.csv", "node,type\n0,x\n10,x\n20,\n"), "--least", "1", "--out", str(tmp_path / "d"))
    assert {r.cell_type for r in spark.read.option("header", True).csv(str(tmp_path / "d" / "types")).collect()} == {"x", "untyped"}
    modules, notes = put("m.csv", "module,graph,node\n1,a,5\n1,a,6\n"), put("n.csv", "node,Super Class\n5,k\n")
    rows = put("r.csv", "graph,src,dst,syn_count,neuropil,nt_type\na,5,6,3,p,q\na,6,9,2,p,q\na,8,9,1,p,q\n")
    run(spark, "modules", "--table", modules, "--mapping", notes, "--nodes", rows, "--out", str(tmp_path / "mo"))
    row = spark.read.option("header", True).csv(str(tmp_path / "mo" / "modules")).first()
    assert (row.internal_rows, row.outgoing_rows, row.internal_syn, row.top_super_class, row.coverage) == ("1", "1", "3", "k:1", "0.5")
    stored = put("s.csv", "mapping,returncode,valid_solution,stdout_log,sample_id\nj,0,1,x.n9.s1.stdout.log,\nk,1,1,y,\n")
    places, index = put("p.csv", "mapping,pos,left_graph,right_graph,li,ri\nj,0,a,b,0,1\nj,1,a,b,1,0\n"), put("i.csv", "graph,idx,node\na,0,1\na,1,2\nb,0,7\nb,1,8\n")
    run(spark, "revalidate", "--table", stored, "--mapping", places, "--nodes", index, "--edges", put("e.csv", "graph,src,dst\na,1,2\nb,8,7\n"), "--out", str(tmp_path / "v"))
    got = spark.read.option("header", True).csv(str(tmp_path / "v" / "revalidated")).collect()
    assert [(r.mapping, r.sample_id, r.is_valid, r.mapped_pairs) for r in got] == [("j", "s1", "true", "2")]


def test_graphs_are_read_once(spark, graphs):
    from skein.plans.cache import GraphCache

    calls, read = [], cli.graphs_of(spark, graphs)
    cache = GraphCache(lambda name: calls.append(name) or read[name])
    assert cache.nodes("a").count() == 14 and cache.labels("a").count() == 14 and cache.edges("a").count() == cache.edges("a").count()
    assert calls == ["a"]
