"""Laws of the language on small fixtures."""

from __future__ import annotations

import pytest

from tessera.api import Engine
from tessera.language.lexer import QueryError
from tessera.sources.catalog import Catalog


@pytest.fixture(scope="module")
def engine(spark):
    cat = Catalog(spark)
    cat.node("Gardener", spark.createDataFrame([("Gardener:1", "Ann", 25), ("Gardener:2", "Ben", 35), ("Gardener:3", "Cy", 25)], "id string, name string, age int"), "id")
    cat.node("Plant", spark.createDataFrame([("Plant:1", "Fern", "Moss"), ("Plant:2", "Rose", "Shrub"), ("Plant:3", "Apple", "Shrub")], "id string, label string, family string"), "id")
    grows = [("Gardener:1", "Plant:1", 2021), ("Gardener:1", "Plant:3", 2022), ("Gardener:2", "Plant:2", 2019), ("Gardener:2", "Plant:3", 2020)]
    cat.edge("GardenerGrowsPlant", spark.createDataFrame(grows, "_from string, _to string, year int"), "_from", "_to")
    cat.node("N", spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int"), "id")
    cat.edge("E", spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "_from int, _to int"), "_from", "_to")
    cat.node("Bag", spark.createDataFrame([(1, [3, 1, 3, 2]), (2, []), (3, [7])], "id int, xs array<int>"), "id")
    return Engine(cat)


W = "links (gardeners)->[grows@w:GardenerGrowsPlant]->(plants@b:Plant)"


def rows(engine, text):
    return sorted((tuple(r) for r in engine.sql(text).collect()), key=repr)


def value(engine, text):
    return engine.query(text).value()


def test_nested_projection(engine):
    got = engine.sql(f"select gardeners@u[*].{{name: u.name, grown: u.grows@w[order by w.year][*].{{year: w.year, labels: w.plants@b[*].label}}}} from gardeners@u:Gardener {W}").collect()
    by = {r["name"]: [(x["year"], x["labels"]) for x in r["grown"]] for r in got}
    assert by == {"Ann": [(2021, ["Fern"]), (2022, ["Apple"])], "Ben": [(2019, ["Rose"]), (2020, ["Apple"])], "Cy": []}


def test_projection_defines_the_shape(engine):
    assert value(engine, "select 1 from gardeners@u:Gardener") == 1
    assert not engine.query("select len(gardeners) from gardeners@u:Gardener").many
    assert engine.query("select gardeners@u[*].name from gardeners@u:Gardener range ..1").many


def test_leaf_and_nest_agree(engine):
    leaf = rows(engine, f"select gardeners@u[*].grows@w[**].plants@b[**].{{n: u.name, t: b.label}} from gardeners@u:Gardener {W}")
    nest = engine.sql(f"select gardeners@u[*].{{n: u.name, ts: u.grows@w[*].plants@b[**].label}} from gardeners@u:Gardener {W}").collect()
    assert leaf == sorted(((r["n"], t) for r in nest for t in r["ts"]), key=repr)
    assert len(leaf) == 4


def test_existence(engine):
    tech = f"select gardeners@u[*].name from gardeners@u:Gardener {W} where u.grows@w[*].plants@b[**].any(|b| b.family == 'Shrub')"
    assert rows(engine, tech) == [("Ann",), ("Ben",)]
    assert rows(engine, tech.replace("any", "none")) == [("Cy",)]
    assert rows(engine, tech.replace("any", "all")) == [("Ben",), ("Cy",)]
    assert rows(engine, f"select gardeners@u[*].name from gardeners@u:Gardener {W} where is_empty(u.grows)") == [("Cy",)]


def test_base_gate_keeps_parents(engine):
    text = "select gardeners@u[*].{n: u.name, k: len(u.grows)} from gardeners@u:Gardener links (gardeners where u.age > 30)->[grows@w:GardenerGrowsPlant]->(plants@b:Plant)"
    assert rows(engine, text) == [("Ann", 0), ("Ben", 2), ("Cy", 0)]


def test_inner_links_drop_parents(engine):
    assert rows(engine, f"select gardeners@u[*].name from gardeners@u:Gardener {W.replace('links', 'links inner')}") == [("Ann",), ("Ben",)]


def test_backward(engine):
    text = "select plants@b[*].{t: b.label, by: len(b.grown)} from plants@b:Plant links (plants)<-[grown@w:GardenerGrowsPlant]<-(gardeners@u:Gardener)"
    assert rows(engine, text) == [("Apple", 2), ("Fern", 1), ("Rose", 1)]


def test_groups(engine):
    text = "select g@x[*].{age: x.age, n: len(x.gardeners), names: x.items()@u[order by u.name][*].name} from gardeners@u:Gardener group by {age: u.age} into g"
    assert rows(engine, text) == [(25, 2, ["Ann", "Cy"]), (35, 1, ["Ben"])]


def test_hops_on_a_cycle(engine):
    base = "select n@n[*].e@e[**].{a: n.id, b: e._to} from n@n:N links (n)->[e@e:E hops %s]->(m@m:N)"
    assert len(rows(engine, base % "1..=3")) == 12
    assert len(rows(engine, base % "1..2")) == 4
    assert len(rows(engine, base % "1..")) == 10  # every node once for each start
    assert len(rows(engine, base % "2..")) == 6
    assert len(rows(engine, "select e.transitive_closure({seed: 1}) from e@e:E")) == 3


def test_both_directions_match_a_loop_once(engine):
    assert len(rows(engine, "select n@n[*].e@e[**].{a: n.id, f: e._from} from n@n:N links (n)<->[e@e:E]<->(m@m:N)")) == 7


def test_arrays(engine):
    bag = "select bags@b[order by b.id][*].{id: b.id, v: %s} from bags@b:Bag"
    assert [r["v"] for r in engine.sql(bag % "b.xs@x[where x > 1][order by x desc]").collect()] == [[3, 3, 2], [], [7]]
    assert [r["v"] for r in engine.sql(bag % "b.xs[distinct]").collect()] == [[3, 1, 2], [], [7]]
    assert [r["v"] for r in engine.sql(bag % "b.xs[1..3]").collect()] == [[1, 3], [], []]
    assert [r["v"] for r in engine.sql(bag % "b.xs.get(5)").collect()] == [None, None, None]
    assert [r["v"] for r in engine.sql(bag % "b.xs.sum()").collect()] == [9, 0, 7]
    assert [r["v"] for r in engine.sql(bag % "b.xs.all(|x| x > 0)").collect()] == [True, True, True]
    assert [r["v"] for r in engine.sql(bag % "b.xs.scan(0, |a, x| {left: a + x, right: a + x})").collect()] == [[3, 4, 7, 9], [], [7]]
    ranks = engine.sql(bag % "b.xs.rank_by(|x| x)").first()["v"]
    assert [(r["value"], r["index"], r["rank"], r["dense_rank"]) for r in ranks] == [(1, 0, 1, 1), (2, 1, 2, 2), (3, 2, 3, 3), (3, 3, 3, 3)]


@pytest.mark.parametrize("expr", ["b.xs[9]", "b.xs.expect_one()"])
def test_runtime_errors(engine, expr):
    with pytest.raises(Exception, match="ELEMENT|element|INVALID_ARRAY_INDEX"):
        engine.sql(f"select bags@b[*].{{v: {expr}}} from bags@b:Bag").collect()


def test_index_out_of_range_over_rows(engine):
    assert value(engine, "select gardeners@u[order by u.id][-1].name from gardeners@u:Gardener") == "Cy"
    with pytest.raises(Exception, match="no element"):
        value(engine, "select gardeners@u[order by u.id][10].name from gardeners@u:Gardener")


def test_many_has_no_fields(engine):
    with pytest.raises(QueryError, match=r"\[\*\]"):
        engine.query("select gardeners.name from gardeners@u:Gardener")
    with pytest.raises(QueryError, match="no field"):
        engine.query("select gardeners@u[*].nothing from gardeners@u:Gardener")
    with pytest.raises(QueryError, match="unknown type"):
        engine.query("select 1 from x@x:Nowhere")


def test_key_by_rejects_repeats(engine):
    assert len(rows(engine, "select gardeners.key_by(|u| u.id) from gardeners@u:Gardener")) == 3
    with pytest.raises(Exception, match="repeated key"):
        rows(engine, "select gardeners.key_by(|u| u.age) from gardeners@u:Gardener")


def test_definitions_go_before_builtins(engine):
    engine.define("twice", "|x| x * 2")
    assert value(engine, "select twice(4) from gardeners@u:Gardener") == 8


def test_values_may_be_passed(engine, spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert sorted(r[0] for r in engine.query("select t@t[where t.k > n][*].v from u@u:Gardener", t=df, n=1).df.collect()) == ["y"]


def test_mutations(spark):
    cat = Catalog(spark)
    cat.node("A", spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, s string, x double"), "id")
    cat.edge("R", spark.createDataFrame([(1, 2, 5)], "_from int, _to int, w int"), "_from", "_to")
    e = Engine(cat)
    made = e.query("create a@a:A [{id: 3, s: 'c'}, {id: 4, x: 4.0}]")
    assert made.many and made.df.count() == 2
    assert e.query("update a@a:A set { a.x += 1.0; a.s = 'z' } where a.x > 1.5").value() == 2
    assert rows(e, "select a@a[*].{i: a.id, s: a.s, x: a.x} from a@a:A") == [(1, "a", 1.0), (2, "z", 3.0), (3, "c", None), (4, "z", 5.0)]
    assert e.query("delete a@a:A where a.x > 4.0").value() == 1
    assert e.query("link (p@p:A where p.id == 1)->[r@r:R {w: 9}]->(q@q:A where q.id != 1)").value() == 2
    assert rows(e, "select r@r[*].{f: r._from, t: r._to, w: r.w} from r@r:R") == [(1, 2, 5), (1, 2, 9), (1, 3, 9)]
    assert e.query("unlink (p@p:A)->[r@r:R where r.w == 9]->(q@q:A)").value() == 2
    e.query("upsert a@a:A [{id: 1, s: 'new'}, {id: 8, s: 'h'}] on conflict (id) merge")
    assert rows(e, "select a@a[*].{i: a.id, s: a.s, x: a.x} from a@a:A")[0] == (1, "new", 1.0)
    assert e.query("create { a@a:A {id: 20}; len(a) }").value() == 1
    with pytest.raises(ValueError, match="unknown fields"):
        e.query("create a@a:A {nope: 1}")


MORE = [
    ("select [gardeners@u[*].age.max(), 3].sum() from gardeners@u:Gardener", [(38,)]),
    ("select gardeners@u[order by u.id][..gardeners.len() - 1][*].name from gardeners@u:Gardener", [("Ann",), ("Ben",)]),
    ("{ let old = (select gardeners@u[where u.age > 30] from gardeners@u:Gardener); select old@o[*].name from old@o }", [("Ben",)]),
    ("select gardeners.map_indexed(|u, i| {i: i, n: u.name}) from (gardeners@u:Gardener order by u.name)", [(0, "Ann"), (1, "Ben"), (2, "Cy")]),
    ("select gardeners@u[*].{n: u.name, k: (u.age, u.name).0} from gardeners@u:Gardener where u.age is i32 && u.name in ['Ben']", [("Ben", 35)]),
    ("select gardeners@u[*].{n: u.name, b: u.plants@b[*].label.len()} from gardeners@u:Gardener links (gardeners)->(plants@b:Plant)", [("Ann", 3), ("Ben", 3), ("Cy", 3)]),
    ("select gardeners@u[*][group by {old: u.age > 30}]@g[*].{o: g.old, n: g.items().len()} from gardeners@u:Gardener", [(False, 2), (True, 1)]),
    ("select i\"n=${len(gardeners)}\" from gardeners@u:Gardener", [("n=3",)]),
    ("select gardeners@u[*].{a: u.age.min(30), m: gardeners.len()} from gardeners@u:Gardener where u.name == 'Ben'", [(30, 1)]),
    ("select {t: time::format(dt'2024-03-01T10:00:00', 'yyyy/MM'), d: dt'2024-03-02' > dt'2024-03-01'} from gardeners@u:Gardener", [("2024/03", True)]),
]


@pytest.mark.parametrize(("text", "want"), MORE)
def test_more(engine, text, want):
    assert rows(engine, text) == want


def test_create_with_links(spark):
    cat = Catalog(spark)
    cat.node("A", spark.createDataFrame([(1, "a")], "id int, s string"), "id")
    cat.edge("R", spark.createDataFrame([(1, 1, 5)], "_from int, _to int, w int"), "_from", "_to")
    e = Engine(cat)
    e.query("create n@n:A {id: 2, s: 'b'} link (n)->[r@r:R {w: 7}]->(m@m:A where m.id == 1)")
    assert rows(e, "select r@r[*].{f: r._from, t: r._to, w: r.w} from r@r:R") == [(1, 1, 5), (2, 1, 7)]


def test_positions_over_many_partitions(spark):
    from pyspark.sql import functions as F

    from tessera.operators.positions import numbered

    df = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("k"))
    got = {r["k"]: r["n"] for r in numbered(df, [F.col("k").desc()], "n").collect()}
    assert got == {k: 999 - k for k in range(1000)}


def test_whole_collections(engine, spark):
    one = lambda text: engine.sql(text).collect()
    assert [r[0] for r in one("select n@n[order by n.id].reversed()[*].id from n@n:N")] == [4, 3, 2, 1]
    assert [r[0] for r in one("select n@n[order by n.id][-2..][*].id from n@n:N")] == [3, 4]
    assert one("select {a: n@n[where n.id == 2].expect_one().id} from n@n:N")[0]["a"] == 2
    with pytest.raises(Exception, match="expected one element"):
        one("select {a: n.expect_one().id} from n@n:N")
    assert sorted(tuple(r) for r in one("select n.map(|x| 5).histogram(3) from n@n:N")) == [(0, 4)]
    assert sorted(r[0] for r in one("select n@n[order by n.id][*].id.moving_average(2) from n@n:N")) == [1.0, 1.5, 2.5, 3.5]
    assert tuple(one("select { let p = n.partition(|x| x.id > 1); {a: p.matched.len(), b: p.rest.len()} } from n@n:N")[0]) == (3, 1)


def test_unlink_refuses_what_it_cannot_tell(engine):
    for path in ("(n@n:N)->[e@e:E hops 1..=2]->(m@m:N)", "(n@n:N)->[e@e:E]->(m@m:N)->[f@f:E]->(k@k:N)"):
        with pytest.raises(QueryError, match="one hop"):
            engine.query(f"unlink {path}")


def test_moving_average_over_blocks(spark, monkeypatch):
    from tessera.plans.compiler import Compiler

    monkeypatch.setattr(Compiler, "BLOCK", 8)
    e = Engine(Catalog(spark))
    values = [(i, float(i * 7 % 31)) for i in range(100)]
    got = e.sql("select xs[order by x.i][*].v.moving_average(5) from xs".replace("xs[", "xs@x["), xs=spark.createDataFrame(values, "i int, v double")).collect()
    want = [sum(v for _, v in values[max(0, i - 4) : i + 1]) / min(5, i + 1) for i in range(100)]
    assert sorted(round(r[0], 9) for r in got) == sorted(round(w, 9) for w in want)


def test_cycles_among_parents_are_an_error(spark):
    from tessera.operators import graph

    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id int, parent int")
    for f in (graph.ancestors, graph.descendants):
        with pytest.raises(ValueError, match="cycle"):
            f(tree, 1)
    assert graph.preorder(tree, 4).count() == 1
    with pytest.raises(ValueError, match="cycle"):
        graph.preorder(spark.createDataFrame([(1, 2), (2, 1)], "id int, parent int"), 1)
