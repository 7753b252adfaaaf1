"""Arrays, sets, maps, lookups, deques, heaps and sorted-array algorithms.

Positions are 0-based as in the language.  All are native higher-order
functions; none leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def at(xs: Column, n: Column) -> Column:
    """The n-th element, from the end if negative; missing is a runtime error."""
    return F.element_at(xs, F.when(n < 0, n).otherwise(n + 1).cast("int"))


def get(xs: Column, n: Column) -> Column:
    return F.try_element_at(xs, F.when(n < 0, n).otherwise(n + 1).cast("int"))


def first(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(1))


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def sliced(xs: Column, start: Column | None, end: Column | None, inclusive: bool = False) -> Column:
    a = F.lit(0) if start is None else start
    a = F.when(a < 0, F.greatest(F.size(xs) + a, F.lit(0))).otherwise(a)
    b = F.size(xs) if end is None else F.when(end < 0, F.size(xs) + end).otherwise(end) + (1 if inclusive else 0)
    return F.slice(xs, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))


def exactly_one(xs: Column) -> Column:
    return F.struct(F.when(F.size(xs) == 1, first(xs)).alias("ok"), F.when(F.size(xs) != 1, F.concat(F.lit("expected one element, found "), F.size(xs).cast("string"))).alias("err"))


def expect_one(xs: Column) -> Column:
    """The only element; a runtime error unless there is exactly one."""
    return F.element_at(F.when(F.size(xs) == 1, xs).otherwise(F.raise_error(F.concat(F.lit("expected one element, found "), F.size(xs).cast("string")))), 1)


def total(xs: Column, zero: Column) -> Column:
    return F.aggregate(F.array_compact(xs), zero, lambda a, x: a + x)


def average(xs: Column) -> Column:
    clean = F.array_compact(xs)
    return F.when(F.size(clean) > 0, F.aggregate(clean, F.lit(0.0), lambda a, x: a + x) / F.size(clean))


def exists(xs: Column, p: Fn) -> Column:
    return F.exists(xs, lambda x: F.coalesce(p(x), F.lit(False)))


def every(xs: Column, p: Fn) -> Column:
    return F.forall(xs, lambda x: F.coalesce(p(x), F.lit(False)))


def where(xs: Column, p: Fn) -> Column:
    return F.filter(xs, lambda x: F.coalesce(p(x), F.lit(False)))


def flattened(xss: Column) -> Column:
    return F.flatten(F.array_compact(xss))


def enumerated(xs: Column) -> Column:
    return F.transform(xs, lambda x, i: F.struct(i.alias("index"), x.alias("value")))


def ordered(xs: Column, keys: list[tuple[Fn, bool]]) -> Column:
    """Stable order by keys (function, descending); nulls come last."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for key, down in reversed(keys):
            x, y = key(a), key(b)
            less, more = (1, -1) if down else (-1, 1)
            out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), 1).when(y.isNull(), -1).when(x < y, less).when(x > y, more).otherwise(out)
        return out

    return F.array_sort(xs, compare)


def distinct_by(xs: Column, key: Fn) -> Column:
    """The first element of each key: sorted by key and place, neighbours tell."""
    keyed = F.array_sort(F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = lambda s: F.filter(s, lambda e, j: (j == 0) | ~e["k"].eqNullSafe(F.get(s, j - 1)["k"]))
    kept = F.element_at(F.transform(F.array(keyed), firsts), 1)
    return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def zipped(xs: Column, ys: Column) -> Column:
    n = F.least(F.size(xs), F.size(ys))
    return F.zip_with(F.slice(xs, 1, n), F.slice(ys, 1, n), lambda x, y: F.struct(x.alias("left"), y.alias("right")))


def reduced(xs: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return F.when(F.size(xs) > 0, F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1))), first(xs), fn))


def scanned(xs: Column, init: Column, fn: Callable[[Column, Column], Column], out_type: str) -> Column:
    """Outputs of a running state; ``fn`` gives a struct of left (state) and right (output)."""
    start = F.struct(init.alias("s"), F.array().cast(f"array<{out_type}>").alias("o"))

    def step(acc: Column, x: Column) -> Column:
        pair = fn(acc["s"], x)
        return F.struct(pair["left"].alias("s"), F.concat(acc["o"], F.array(pair["right"].cast(out_type))).alias("o"))

    return F.aggregate(xs, start, step, lambda acc: acc["o"])


def ranked(xs: Column, key: Fn, down: bool = False) -> Column:
    """value, index (0-based), rank and dense_rank in key order."""
    by = ordered(xs, [(key, down)])
    keys = F.transform(by, key)
    uniq = F.array_distinct(keys)
    return F.transform(
        by, lambda x, i: F.struct(x.alias("value"), i.alias("index"), F.array_position(keys, key(x)).cast("int").alias("rank"), F.array_position(uniq, key(x)).cast("int").alias("dense_rank"))
    )


def partitioned(xs: Column, p: Fn) -> Column:
    return F.struct(where(xs, p).alias("matched"), F.filter(xs, lambda x: ~F.coalesce(p(x), F.lit(False))).alias("rest"))


def index_by(xs: Column, key: Fn) -> Column:
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(xs, key)), lambda k: F.struct(k.alias("key"), F.filter(xs, lambda x: key(x) == k).alias("value"))))


def key_by(xs: Column, key: Fn) -> Column:
    """A map by unique key; a repeated key is a runtime error."""
    return F.map_from_entries(F.transform(xs, lambda x: F.struct(key(x).alias("key"), x.alias("value"))))


def associate_by(xs: Column, key: Fn, value: Fn) -> Column:
    return F.map_from_entries(F.transform(xs, lambda x: F.struct(key(x).alias("key"), value(x).alias("value"))))


# sets
def set_with(s: Column, v: Column) -> Column:
    return F.array_union(s, F.array(v))


def set_without(s: Column, v: Column) -> Column:
    return F.array_except(s, F.array(v))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_except(F.array_union(a, b), F.array_intersect(a, b))


def is_subset(a: Column, b: Column) -> Column:
    return F.forall(a, lambda x: F.array_contains(b, x))


def is_superset(a: Column, b: Column) -> Column:
    return is_subset(b, a)


# sorted arrays
def lower_bound(xs: Column, k: Column) -> Column:
    return F.size(F.filter(xs, lambda x: x < k))


def upper_bound(xs: Column, k: Column) -> Column:
    return F.size(F.filter(xs, lambda x: x <= k))


def equal_range(xs: Column, k: Column) -> Column:
    return F.struct(lower_bound(xs, k).alias("start"), upper_bound(xs, k).alias("end"))


def binary_search(xs: Column, k: Column) -> Column:
    p = F.array_position(xs, k)
    return F.when(p > 0, (p - 1).cast("int"))


def binary_search_by(xs: Column, key: Fn, k: Column) -> Column:
    return binary_search(F.transform(xs, key), k)


def partition_point(xs: Column, p: Fn) -> Column:
    return F.size(where(xs, p))


def top_k(xs: Column, k: Column, key: Fn | None = None) -> Column:
    return F.slice(ordered(xs, [(key or (lambda x: x), True)]), 1, k.cast("int"))


def btree_range(xs: Column, lo: Column, hi: Column, inclusive: bool = False) -> Column:
    return F.filter(F.array_sort(xs), lambda x: (x >= lo) & ((x <= hi) if inclusive else (x < hi)))


def btree_lower_bound(xs: Column, k: Column) -> Column:
    return first(F.filter(F.array_sort(xs), lambda x: x >= k))


def btree_upper_bound(xs: Column, k: Column) -> Column:
    return first(F.filter(F.array_sort(xs), lambda x: x > k))


# maps and lookups
def map_get_many(m: Column, k: Column) -> Column:
    v = F.try_element_at(m, k)
    return F.coalesce(v, F.filter(v, lambda x: F.lit(False)), F.array())


def map_get_or(m: Column, k: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, k), default)


def map_with(m: Column, k: Column, v: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v))


def map_without(m: Column, k: Column) -> Column:
    return F.map_filter(m, lambda x, _: x != k)


def map_merge(a: Column, b: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """Both maps' entries; of a key in both, ``fn`` joins the values."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(fn(x, y)))


def map_range(m: Column, lo: Column | None, hi: Column | None) -> Column:
    """Entries of the keys from ``lo`` to below ``hi``, by key."""
    entries = F.array_sort(F.map_entries(m))
    return F.filter(entries, lambda e: (F.lit(True) if lo is None else e["key"] >= lo) & (F.lit(True) if hi is None else e["key"] < hi))


def map_bound(m: Column, k: Column, after: bool) -> Column:
    """The entry of the least key not below (or above) ``k``."""
    return first(F.array_sort(F.filter(F.map_entries(m), lambda e: e["key"] > k if after else e["key"] >= k)))


# statistics
def variance(xs: Column) -> Column:
    """Of a sample; of fewer than two, none."""
    mean = average(xs)
    return F.when(F.size(xs) > 1, F.element_at(F.transform(F.array(mean), lambda m: F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))), 1) / (F.size(xs) - 1))


def stddev(xs: Column) -> Column:
    return F.sqrt(variance(xs))


def quantile(xs: Column, q: Column) -> Column:
    """With interpolation between neighbours."""

    def between(s: Column) -> Column:
        at = (F.size(s) - 1) * q
        lo, hi = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
        return lo + (hi - lo) * (at - F.floor(at))

    return F.when(F.size(xs) > 0, F.element_at(F.transform(F.array(F.array_sort(xs)), between), 1).cast("double"))


def moving_average(xs: Column, width: Column) -> Column:
    return F.transform(xs, lambda _, i: average(F.slice(xs, F.greatest(i + 2 - width, F.lit(1)).cast("int"), F.least(i + 1, width).cast("int"))))


def histogram(xs: Column, n: Column) -> Column:
    """Used cells of equal width: {cell (0-based), count}; equal values are all in the first."""
    lo, hi = F.array_min(xs), F.array_max(xs)
    width = (hi - lo) / n
    cells = F.transform(xs, lambda x: F.when(width == 0, 0).otherwise(F.least(F.floor((x - lo) / F.nullif(width, F.lit(0.0))), n - 1)).cast("int"))
    used = F.array_sort(F.array_distinct(cells))
    return F.transform(used, lambda c: F.struct(c.alias("cell"), F.size(F.filter(cells, lambda x: x == c)).cast("long").alias("count")))


# deques and heaps
def pop_front(xs: Column) -> Column:
    return F.struct(first(xs).alias("value"), F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1))).alias("rest"))


def pop_back(xs: Column) -> Column:
    return F.struct(last(xs).alias("value"), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))).alias("rest"))


def heap_pop(xs: Column) -> Column:
    top = F.array_max(xs)
    rest = F.filter(xs, lambda x, i: i + 1 != F.array_position(xs, top))
    return F.struct(top.alias("value"), rest.alias("rest"))
