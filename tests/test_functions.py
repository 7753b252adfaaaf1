"""The function library on constants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import collections as C
from tessera.functions import geo as G
from tessera.functions import numbers as N
from tessera.functions import text as X
from tessera.functions import times as T
from tessera.functions import vectors as V


@pytest.fixture(scope="module")
def one(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first()["v"]


def arr(*xs):
    return F.array(*(F.lit(x) for x in xs))


def test_numbers(one):
    assert one(N.clamp(F.lit(9), F.lit(1), F.lit(5))) == 5
    assert one(N.is_finite(F.lit(float("nan")))) is False
    assert float(one(N.rounded(F.lit(2.5), 0, "HalfEven"))) == 2
    assert float(one(N.rounded(F.lit(-2.45), 1, "Floor"))) == -2.5
    assert str(one(N.decimal(F.lit(1234), 2))) == "12.34"
    total = one(N.money_add(N.money(F.lit(1.5), F.lit("EUR")), N.money(F.lit(2.0), F.lit("EUR"))))
    assert (total["amount"], total["currency"]) == (3.5, "EUR")
    with pytest.raises(Exception, match="currency mismatch"):
        one(N.money_add(N.money(F.lit(1.5), F.lit("EUR")), N.money(F.lit(2.0), F.lit("USD"))))
    assert one(N.money_convert(N.money(F.lit(10.0), F.lit("EUR")), N.exchange_rate(F.lit("EUR"), F.lit("USD"), F.lit(1.1))))["currency"] == "USD"


def test_text(one):
    assert one(X.normalize(F.lit("  A  b\tC "))) == "a b c"
    assert one(X.tokens(F.lit("Ab, c-d!"))) == ["ab", "c", "d"]
    assert one(X.ngrams(F.lit("a b c"), 2)) == [["a", "b"], ["b", "c"]]
    assert one(X.ngrams(F.lit("a"), 2)) == []
    assert one(X.slugify(F.lit("Hello, World!"))) == "hello-world"


@pytest.mark.parametrize(("text", "seconds"), [("1h30m", 5400), ("3w", 1814400), ("PT1H30M", 5400), ("P1DT2S", 86402), ("250ms", 0.25)])
def test_durations(text, seconds):
    assert T.seconds_of(text) == seconds


def test_bad_duration():
    with pytest.raises(ValueError, match="not a duration"):
        T.seconds_of("soon")


def test_ranges(one):
    a, b = T.span(F.lit(1), F.lit(5)), T.span(F.lit(5), F.lit(9))
    assert one(T.span_contains(a, F.lit(5))) is False
    assert one(T.span_contains(T.span(F.lit(1), F.lit(5), True), F.lit(5))) is True
    assert one(T.span_overlaps(a, b)) is False
    assert one(T.span_union(a, b))["end"] == 9
    assert one(T.total_seconds(T.duration("1h1s"))) == 3601


def test_collections(one):
    xs = arr(3, 1, 2, 3)
    assert one(C.at(xs, F.lit(-1))) == 3
    assert one(C.sliced(xs, F.lit(1), F.lit(3))) == [1, 2]
    assert one(C.sliced(xs, F.lit(-2), None)) == [2, 3]
    assert one(C.distinct_by(xs, lambda x: x % 2)) == [3, 2]
    assert one(C.zipped(xs, arr(9))) [0]["right"] == 9
    assert one(C.reduced(xs, lambda a, x: a * x)) == 18
    assert one(C.top_k(xs, F.lit(2))) == [3, 3]
    assert one(C.lower_bound(arr(1, 2, 2, 5), F.lit(2))) == 1
    assert one(C.upper_bound(arr(1, 2, 2, 5), F.lit(2))) == 3
    assert one(C.symmetric_difference(arr(1, 2), arr(2, 3))) == [1, 3]
    assert one(C.heap_pop(xs))["value"] == 3
    assert one(C.heap_pop(xs))["rest"] == [1, 2, 3]
    assert one(C.pop_front(xs))["rest"] == [1, 2, 3]
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert one(C.map_with(m, F.lit("a"), F.lit(7))) == {"b": 2, "a": 7}
    assert one(C.map_merge(m, F.create_map(F.lit("b"), F.lit(5)), lambda x, y: x + y)) == {"a": 1, "b": 7}
    assert one(C.index_by(xs, lambda x: x % 2)) == {1: [3, 1, 3], 0: [2]}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        one(C.key_by(xs, lambda x: x))


def test_geo(one):
    p = lambda x, y: G.point(F.lit(x), F.lit(y))
    square = F.array(p(0, 0), p(2, 0), p(2, 2), p(0, 2))
    assert one(G.area(square)) == 4
    assert one(G.centroid(square)).asDict() == {"lon": 1.0, "lat": 1.0}
    assert one(G.ring_contains(square, p(1, 1))) is True
    assert one(G.ring_contains(square, p(3, 1))) is False
    assert abs(one(G.haversine(p(-0.1276, 51.5072), p(2.3522, 48.8566))) / 1000 - 343.5) < 1
    assert one(G.length(F.array(p(0, 0), p(3, 4)))) == 5
    assert one(G.box_touches(G.bounding_box(square), G.bbox(F.lit(2), F.lit(0), F.lit(3), F.lit(1)))) is True
    assert one(G.covering_cells(G.bounding_box(square), 2.0)) == ["0:0", "0:1", "1:0", "1:1"]
    assert abs(one(G.tile_bounds(F.lit(0), F.lit(0), F.lit(0)))["north"] - 85.0511) < 1e-3


def test_vectors(one):
    assert one(V.cosine(arr(1.0, 0.0), arr(1.0, 1.0))) == pytest.approx(0.7071, abs=1e-4)


def test_a_ring_is_evaluated_once(spark):
    """What a geometry is computed from stands once in the plan, also where it is itself computed."""
    ring = F.array(*(G.point(F.col("id") * x, F.lit(y)) for x, y in ((0, 0), (1, 0), (1, 4), (0, 4))))
    box = G.bounding_box(ring)
    shapes = [G.area(ring), G.centroid(ring)["lon"], G.length(ring), G.box_touches(box, G.bbox(*(F.lit(v) for v in (2, 0, 9, 3)))), F.size(G.covering_cells(box, 2.0)), F.size(G.simplify(ring, 1.0))]
    for shape in shapes:
        plan = spark.range(2, 3).select(shape.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(id#") == 2, plan
    assert list(spark.range(2, 3).select(*(s.alias(str(i)) for i, s in enumerate(shapes))).first()) == [8.0, 1.0, 8.0, True, 6, 4]
