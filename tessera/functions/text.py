"""Text."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern of an address, anchored.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"


def normalize(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def tokens(s: Column) -> Column:
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, not in every lambda that names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(s: Column, n: int) -> Column:
    def of(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(t, i, n))

    return bound(tokens(s), of)


def slugify(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))


def phrase_positions(s: Column, phrase: list[str]) -> Column:
    """Token positions at which the words of a phrase stand in a row."""

    def of(t: Column) -> Column:
        stands = lambda i: reduce(and_, (F.get(t, i + k) == w for k, w in enumerate(phrase)))
        return F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0))), stands)

    return bound(tokens(s), of)
