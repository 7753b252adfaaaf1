from __future__ import annotations

import pytest

from tessera.operators import graph, search
from tessera.operators.shared import cut


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 5.0), (3, 4, 1.0), (5, 6, 2.0), (7, 7, 1.0)], "_from int, _to int, w double")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(edges):
    assert dict(pairs(graph.connected_components(edges))) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    assert dict(pairs(graph.strongly_connected_components(edges))) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_paths(edges):
    assert dict(pairs(graph.shortest_path(edges, 1, weight="w"))) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert pairs(graph.transitive_closure(edges, 5)) == [(5, 6)]
    assert len(pairs(graph.traverse(edges, 1, 1, 3))) == 4
    assert pairs(graph.neighbors(edges, 3)) == [(1,), (2,), (4,)]


def test_topological_sort(spark):
    dag = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "_from int, _to int")
    assert dict(pairs(graph.topological_sort(dag))) == {1: 0, 2: 1, 3: 1, 4: 2}
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_sort(spark.createDataFrame([(1, 2), (2, 1)], "_from int, _to int"))


def test_pagerank(edges):
    rank = dict(pairs(graph.pagerank(edges, iterations=20)))
    assert sum(rank.values()) == pytest.approx(1)
    assert rank[6] > rank[5]


def test_tree(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3)], "id int, parent int")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(graph.preorder(tree, 1)) == [1, 2, 4, 5, 3, 6]
    assert ids(graph.postorder(tree, 1)) == [4, 5, 2, 6, 3, 1]
    assert ids(graph.level_order(tree, 1)) == [1, 2, 3, 4, 5, 6]
    assert pairs(graph.ancestors(tree, 4)) == [(1, 2), (2, 1)]
    assert graph.path_to_root(tree, 4).first()["path"] == [4, 2, 1]
    assert graph.depth(tree, 1).first()["depth"] == 0
    assert ids(graph.lowest_common_ancestor(tree, 4, 5)) == [2]
    assert ids(graph.lowest_common_ancestor(tree, 4, 6)) == [1]


def test_rounds_do_not_grow_from_each_other(spark):
    tree = spark.range(64).selectExpr("id", "case when id > 1 then id div 2 end as parent")
    steps, front, sizes = tree.where("parent is not null").selectExpr("id as b", "parent as a"), tree.where("id = 1").select("id"), []
    for _ in range(5):
        front = cut(front.join(steps, front["id"] == steps["a"]).select(steps["b"].alias("id")))
        sizes.append(front._jdf.queryExecution().optimizedPlan().constraints().size())
    assert front.count() == 32
    assert sizes == [0] * 5


def test_deep_tree_takes_few_rounds(spark, monkeypatch):
    """A path of 50 nodes with a leaf on each: rounds go with the digits of the depth."""
    n, rounds = 50, []
    tree = spark.range(1, 2 * n + 1).selectExpr("id", f"case when id > {n} then id - {n} when id > 1 then id - 1 end as parent")
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    down = [(i, i - 1) for i in range(1, n + 1)]
    up = [(n + i, i) for i in range(n, 0, -1)]
    got = {f: [tuple(r) for r in getattr(graph, f)(tree, 1).collect()] for f in ("preorder", "postorder", "level_order", "descendants")}
    assert got["preorder"] == down + up
    assert got["postorder"] == [x for i in range(n, 0, -1) for x in ((n + i, i), (i, i - 1))]
    assert got["level_order"] == [(1, 0)] + [x for i in range(1, n) for x in ((i + 1, i), (n + i, i))] + [(2 * n, n)]
    assert sorted(got["descendants"]) == sorted((down + up)[1:])
    assert len(rounds) < 100


@pytest.mark.parametrize("rows", [[(1, 3), (2, 1), (3, 2)], [(1, 1), (2, 1)]])
def test_cycle_in_a_tree_is_an_error(spark, rows):
    tree = spark.createDataFrame(rows, "id int, parent int")
    for f in (graph.descendants, graph.preorder):
        with pytest.raises(ValueError, match="cycle"):
            f(tree, 1)


def test_repeated_rows_and_other_trees(spark):
    ids = lambda df: [r["id"] for r in df.collect()]
    twice = spark.createDataFrame([(1, None), (2, 1), (2, 1), (3, 2), (5, 1)], "id int, parent int")
    assert ids(graph.preorder(twice, 1)) == [1, 2, 2, 3, 3, 5]
    apart = spark.createDataFrame([(1, None), (2, 1), (7, None), (8, 7), (20, 21), (21, 20), (None, 1)], "id int, parent int")
    assert ids(graph.preorder(apart, 1)) == [1, None, 2]
    assert pairs(graph.descendants(apart, 7)) == [(8, 1)]
    assert ids(graph.postorder(apart, 99)) == []


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "the red old fox"), (3, "blue sea")], "id int, text string")
    assert [r["id"] for r in search.full_text(docs, "id", "text", "red fox").collect()] == [1, 2]
    assert pairs(search.phrase(docs, "id", "text", "red fox")) == [(1, 0)]
    assert pairs(search.phrase(docs, "id", "text", "red fox", slop=1)) == [(1, 0), (2, 1)]
    assert search.all_terms(docs, "text", "fox red").count() == 2
    two = search.hybrid(search.full_text(docs, "id", "text", "red"), search.full_text(docs, "id", "text", "fox"), 2)
    assert two.count() == 2
    at = spark.createDataFrame([(1, 2.35, 48.85), (2, -0.12, 51.5)], "id int, lon double, lat double")
    assert [r["id"] for r in search.within_radius(at, "lon", "lat", (2.3, 48.8), 20_000).collect()] == [1]
    assert [r["id"] for r in search.nearest(at, "lon", "lat", (0.0, 51.0), 1).collect()] == [2]
