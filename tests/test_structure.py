import itertools
import random
from collections import deque

import pytest

from skein.operators import common_subgraph as mcs
from skein.operators import graph as g
from skein.operators import sampling as sample
from skein.operators import strong
from skein.sinks import text as sinks
from skein.sources import solver_log

E = "src long, dst long"


def some_edges(n, m, seed):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    got = {}
    for n in out:
        seen, todo = {n}, [n]
        while todo:
            for b in out[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        got[n] = seen
    return got


@pytest.mark.parametrize("bound", [0, 10**6])
@pytest.mark.parametrize("edges", [some_edges(14, 20, 5), [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], []])
def test_strong_components_and_levels_both_ways(spark, monkeypatch, bound, edges):
    monkeypatch.setattr(strong, "ONE_TASK", bound)
    df = spark.createDataFrame(edges, E)
    r = reach(edges)
    want = {n: min(m for m in s if n in r[m]) for n, s in r.items()}
    labels = strong.strong_components(df)
    assert {x.node: x.component for x in labels.collect()} == want
    dag = {(want[a], want[b]) for a, b in edges if want[a] != want[b]}
    level = {n: 0 for e in dag for n in e}
    for _ in level:
        for a, b in dag:
            level[b] = max(level[b], level[a] + 1)
    got = strong.dag_levels(strong.condensed(df, labels).where("src <> dst"))
    assert {x.node: x.level for x in got.collect()} == level


@pytest.mark.parametrize("bound", [0, 10**6])
def test_levels_refuse_cycles(spark, monkeypatch, bound):
    monkeypatch.setattr(strong, "ONE_TASK", bound)
    with pytest.raises(Exception, match="cycles"):
        strong.dag_levels(spark.createDataFrame([(1, 2), (2, 1), (0, 1)], E)).collect()


def queue_walk(edges, key):
    """All nodes in the order of a queue that starts anew, at the first node by ``key`` that is left, when it is empty."""
    near, degree = {}, {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            degree[x] = degree.get(x, 0) + 1
            near.setdefault(x, set())
            if x != y:
                near[x].add(y)
    want, queue = [], deque()
    for start in sorted(near, key=lambda n: key(degree[n], n)):
        if start in want:
            continue
        want.append(start)
        queue.append(start)
        while queue:
            for y in sorted(near[queue.popleft()], key=lambda n: key(degree[n], n)):
                if y not in want:
                    want.append(y)
                    queue.append(y)
    return want


def test_bfs_sample_walks_component_after_component(spark):
    edges = [e for i in range(12) for e in [(10 * i, 10 * i + 1), (10 * i + 1, 10 * i + 2), (10 * i + 3, 10 * i + 1)][: i % 3 + 1]]
    edges += [(200, 200), (201, 201)]
    want, df = queue_walk(edges, lambda d, n: (d, n)), spark.createDataFrame(edges, E)
    for size in (9, len(want) - 1):
        rows = sample.bfs_sample(df, size, sample.low_first()).orderBy("pos").collect()
        assert [x.pos for x in rows] == list(range(size)) and [x.node for x in rows] == want[:size]
    # nodes without a degree are not met, nor passed
    some = g.total_degree(df).where("node <> 21")
    got = [x.node for x in sample.bfs_sample(df, some.count(), sample.low_first(), degrees=some).orderBy("pos").collect()]
    assert sorted(got) == sorted(n for n in want if n != 21)


def test_bfs_sample_is_the_queue_walk(spark):
    edges = some_edges(60, 80, 2)
    want = near = queue_walk(edges, lambda d, n: (-d, n))
    df = spark.createDataFrame(edges, E)
    size = len(near) - 2
    got = [x.node for x in sample.bfs_sample(df, size, sample.high_first()).orderBy("pos").collect()]
    assert got == want[:size]
    star = spark.createDataFrame([(0, i) for i in range(1, 80)], E)
    got = [x.node for x in sample.bfs_sample(star, 70, sample.high_first(), seed=3).orderBy("pos").collect()]
    assert got[0] == 0 and sorted(got[1:33]) == list(range(1, 33)) and got[1:33] != list(range(1, 33)) and got[33:] == list(range(33, 70))
    with pytest.raises(ValueError):
        sample.bfs_sample(df, len(near) + 1, sample.high_first())
    assert sample.bfs_sample(df, 0, sample.high_first()).count() == 0


def test_sparse_sample_and_quantile(spark):
    df = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (5, 7), (5, 5)], E)
    assert [x.node for x in sample.sparse_sample(df, 4, pool=3).orderBy("pos").collect()] == [1, 3, 6, 7]
    assert sample.lower_quantile(g.total_degree(df), 0.35) == 1
    assert sample.lower_quantile(g.total_degree(df), 1.0) == 4


def test_independent_sets_are_maximal(spark):
    edges = some_edges(40, 70, 9)
    df = spark.createDataFrame(edges, E)
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for e in edges for n in e}
    sets = {}
    for x in sample.independent_sets(df, 3).collect():
        sets.setdefault(x.trial, set()).add(x.node)
    assert len(sets) == 3
    for s in sets.values():
        assert all(b not in s for n in s for b in near[n] - {n})
        assert all(near[n] & s for n in near if n not in s)
    assert sample.best_independent_set(df, 3).count() == max(map(len, sets.values()))


def agrees(m, left, right):
    return all(((a, b) in left) == ((x, y) in right) for (a, x), (b, y) in itertools.permutations(m, 2))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_common_subgraph_is_the_largest(seed):
    left, right = ([e for e in some_edges(5, 9, s)] for s in (seed, seed + 50))
    found, done = mcs.common_subgraphs(left, right, 10**6)
    nodes = [sorted({n for e in x for n in e}) for x in (left, right)]
    sizes = [k for k in range(1, 1 + min(map(len, nodes))) for a in itertools.combinations(nodes[0], k) for b in itertools.permutations(nodes[1], k) if agrees(list(zip(a, b, strict=True)), set(left), set(right))]
    assert done and len(found[-1]) == max(sizes)
    assert all(agrees(m, set(left), set(right)) for m in found)
    assert [len(m) for m in found] == sorted({len(m) for m in found})


def test_jobs_go_on_after_a_failure(spark):
    rows = [("good", [(1, 2)], [(5, 6)]), ("null", None, [(1, 2)]), ("empty", [], [])]
    jobs = spark.createDataFrame(rows, "job string, left_edges array<struct<src:long,dst:long>>, right_edges array<struct<src:long,dst:long>>")
    got = mcs.solve_jobs(jobs)
    assert sorted(map(tuple, mcs.best_mapping(got).collect())) == [("good", 0, 1, 5), ("good", 1, 2, 6)]
    assert [x.job for x in got.where("error is not null").collect()] == ["null"]


def test_text_graphs(spark, tmp_path):
    df = spark.createDataFrame([(10, 30), (30, 10), (20, 20), (30, 20)], E)
    lines, index = sinks.dimacs_lines(df)
    assert [x.value for x in lines.collect()] == ["p edge 3 4", "e 1 3", "e 2 2", "e 3 1", "e 3 2"]
    assert sorted(map(tuple, index.collect())) == [(10, 1), (20, 2), (30, 3)]
    assert [x.value for x in sinks.kahip_lines(df)[0].collect()] == ["3 2", "3", "3", "1 2"]
    m = spark.createDataFrame([(0, "a", 1), (0, "b", 9), (1, "a", 2), (1, "b", 8)], "pos long, graph string, node long")
    sinks.write_mapping(m, ["b", "a"], str(tmp_path / "m"))
    assert [tuple(x) for x in spark.read.option("header", True).csv(str(tmp_path / "m")).collect()] == [("9", "1"), ("8", "2")]
    sinks.write_node_list(index, str(tmp_path / "n"))
    assert [x.value for x in spark.read.text(str(tmp_path / "n")).collect()] == ["10", "20", "30"]


def test_solver_logs(spark):
    head = ",".join(map(str, range(10)))
    values = ["noise", head, "M 0 4", "M 1 5", "1, 2", head, "M 2 2"]
    lines = spark.createDataFrame([("j", i, v) for i, v in enumerate(values)], "job string, line_no long, value string")
    got = [(x.block, len(x.metrics), [tuple(p) for p in x.pairs]) for x in solver_log.log_blocks(lines, "job").orderBy("block").collect()]
    assert got == [(1, 10, [(0, 4), (1, 5)]), (2, 10, [(2, 2)])]
    files = spark.createDataFrame([("a_b_n30.csv",), ("other",)], "f string")
    parts = files.select(solver_log.named_parts(files.f, r"^(.+)_n(\d+)\.csv$", ["stem", "size"]).alias("x")).select("x.*")
    assert [tuple(x) for x in parts.collect()] == [("a_b", "30"), (None, None)]
    text = spark.createDataFrame([(0, "- nodes: 5"), (1, "nodes: 6"), (2, "plain")], "line_no long, value string")
    assert [tuple(x) for x in solver_log.summary_values(text).collect()] == [("nodes", "6")]
