"""Names of the language to Column builders.

``FUNCTIONS`` are called as ``ns::name(...)`` or ``name(...)``, ``METHODS`` as
``x.name(...)`` on columns.  ``raw`` lists arguments that must be literals and
reach the builder as Python values.  ``returns`` is a type name, "same" for
the type of the first argument, or None where Spark is asked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from tessera.functions import collections as C
from tessera.functions import geo as G
from tessera.functions import numbers as N
from tessera.functions import text as X
from tessera.functions import times as T
from tessera.functions import vectors as V


@dataclass(frozen=True)
class Function:
    build: Callable
    returns: str | None = None
    raw: tuple[int, ...] = ()


def _f(build: Callable, returns: str | None = None, *raw: int) -> Function:
    return Function(build, returns, raw)


_MATH = {
    "abs": _f(F.abs, "same"), "sign": _f(N.sign, "double"), "min": _f(F.least, "same"), "max": _f(F.greatest, "same"), "clamp": _f(N.clamp, "same"),
    "pow": _f(F.pow, "double"), "sqrt": _f(F.sqrt, "double"), "log": _f(F.ln, "double"), "log2": _f(F.log2, "double"), "log10": _f(F.log10, "double"), "exp": _f(F.exp, "double"),
    "sin": _f(F.sin, "double"), "cos": _f(F.cos, "double"), "tan": _f(F.tan, "double"), "floor": _f(F.floor), "ceil": _f(F.ceil),
    "round": _f(lambda x, n=0, mode="HalfUp": N.rounded(x, n, mode), None, 1, 2), "is_nan": _f(F.isnan, "boolean"), "is_finite": _f(N.is_finite, "boolean"),
}
_TEXT = {
    "lower": _f(F.lower, "string"), "upper": _f(F.upper, "string"), "trim": _f(F.trim, "string"), "concat": _f(lambda *xs: F.concat(*(x.cast("string") for x in xs)), "string"),
    "normalize": _f(X.normalize, "string"), "tokens": _f(X.tokens), "ngrams": _f(X.ngrams, None, 1), "contains": _f(F.contains, "boolean"), "starts_with": _f(F.startswith, "boolean"),
    "ends_with": _f(F.endswith, "boolean"), "regex_match": _f(lambda p, s: F.rlike(s, p), "boolean"), "len": _f(F.length, "int"), "slugify": _f(X.slugify, "string"),
    "replace": _f(F.replace, "string"),
}
_TIME = {
    "now": _f(F.current_timestamp, "timestamp"), "date": _f(F.make_date, "date"), "datetime": _f(F.to_timestamp, "timestamp"), "datetime_parse": _f(F.to_timestamp, "timestamp"),
    "duration": _f(T.duration, None, 0), "duration_parse": _f(T.duration, None, 0), "duration_seconds": _f(T.duration_seconds), "format": _f(F.date_format, "string", 1),
    "truncate": _f(lambda v, unit: F.date_trunc(unit, v), None, 1), "bucket": _f(T.bucket, None, 1), "timezone": _f(F.from_utc_timestamp, "timestamp"),
}
_MONEY = {
    "decimal": _f(N.decimal, None, 1), "decimal_parse": _f(N.decimal_parse, None, 1), "currency": _f(lambda c: c, "string"), "money": _f(N.money), "exchange_rate": _f(N.exchange_rate),
}
_GEO = {
    "point": _f(G.point), "bbox": _f(G.bbox), "bounding_box": _f(G.bounding_box), "centroid": _f(G.centroid), "area": _f(G.area, "double"), "length": _f(G.length, "double"),
    "distance": _f(G.distance, "double"), "haversine_distance": _f(G.haversine, "double"), "contains": _f(G.ring_contains, "boolean"), "within": _f(lambda p, r: G.ring_contains(r, p), "boolean"),
    "intersects": _f(G.box_intersects, "boolean"), "overlaps": _f(G.box_overlaps, "boolean"), "touches": _f(G.box_touches, "boolean"), "covering_cells": _f(G.covering_cells, None, 1), "tile_bounds": _f(G.tile_bounds),
    "box_contains": _f(G.box_contains, "boolean"), "simplify": _f(G.simplify, None, 1), "transform": _f(G.transform, None, 1),
}
_VECTOR = {"dot": _f(V.dot, "double"), "norm": _f(V.norm, "double"), "cosine": _f(V.cosine, "double")}
_ALGO = {
    "binary_search": _f(C.binary_search, "int"), "lower_bound": _f(C.lower_bound, "int"), "upper_bound": _f(C.upper_bound, "int"), "equal_range": _f(C.equal_range), "top_k": _f(C.top_k, "same"),
}

FUNCTIONS: dict[str, Function] = {}
for _ns, _fns in {"math": _MATH, "text": _TEXT, "string": _TEXT, "time": _TIME, "geo": _GEO, "vector": _VECTOR, "algo": _ALGO, "": _MONEY}.items():
    FUNCTIONS |= {f"{_ns}::{n}" if _ns else n: f for n, f in _fns.items()}
FUNCTIONS |= {
    "concat": _TEXT["concat"], "now": _TIME["now"], "uuid": _f(F.uuid, "string"), "desc": _f(lambda x: x, "same"), "asc": _f(lambda x: x, "same"),
    "money::round": _f(N.money_round, None, 1, 2), "regex::email": _f(lambda: F.lit(X.EMAIL), "string"), "coalesce": _f(F.coalesce, "same"), "json::get": _f(F.get_json_object, "string", 1),
    **{n: _MATH[n] for n in ("abs", "sqrt", "floor", "ceil", "round")},
}

METHODS: dict[str, Function] = {
    **{n: _MATH[n] for n in ("abs", "sign", "clamp", "sqrt", "round", "floor", "ceil")},
    "pow": _f(F.pow, "double"), "min": _f(F.least, "same"), "max": _f(F.greatest, "same"),
    **{n: _TEXT[n] for n in ("lower", "upper", "trim", "replace", "starts_with", "ends_with", "slugify")},
    "to_upper": _TEXT["upper"], "to_lower": _TEXT["lower"],
    "amount": _f(lambda p: p["amount"]), "currency": _f(lambda p: p["currency"], "string"), "add": _f(N.money_add), "convert": _f(N.money_convert, None, 2, 3),
    "total_seconds": _f(T.total_seconds, "double"), "overlaps": _f(T.span_overlaps, "boolean"),
    "centroid": _GEO["centroid"], "area": _GEO["area"], "bounding_box": _GEO["bounding_box"], "length": _GEO["length"], "distance": _GEO["distance"], "haversine_distance": _GEO["haversine_distance"], "within": _GEO["within"],
    "simplify": _GEO["simplify"], "transform": _GEO["transform"],
    # maps
    "keys": _f(F.map_keys), "values": _f(F.map_values), "entries": _f(F.map_entries), "into_array": _f(F.map_entries), "contains_key": _f(F.map_contains_key, "boolean"),
    "get_or": _f(C.map_get_or), "get_many": _f(C.map_get_many),
    # sets and sequences as arrays
    "with": _f(C.set_with, "same"), "without": _f(C.set_without, "same"), "symmetric_difference": _f(C.symmetric_difference, "same"), "is_subset": _f(C.is_subset, "boolean"), "is_superset": _f(C.is_superset, "boolean"),
    "push_front": _f(F.array_prepend, "same"), "push_back": _f(F.array_append, "same"), "push": _f(F.array_append, "same"), "pop_front": _f(C.pop_front), "pop_back": _f(C.pop_back),
    "front": _f(C.first), "back": _f(C.last), "peek": _f(F.array_max), "pop": _f(C.heap_pop), "into_sorted_array": _f(F.array_sort, "same"),
    "to_hash_set": _f(F.array_distinct, "same"), "to_btree_set": _f(lambda x: F.array_sort(F.array_distinct(x)), "same"), "to_array": _f(lambda x: x, "same"), "to_hash_map": _f(F.map_from_entries), "to_btree_map": _f(lambda x: F.map_from_entries(F.array_sort(x))),
    **{n: _ALGO[n] for n in ("binary_search", "lower_bound", "upper_bound", "equal_range")},
}
