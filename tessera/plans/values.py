"""What an expression stands for while a query is compiled.

``Rel``   many elements as rows of a DataFrame,
``Val``   one value as a Column of the rows at hand (or a constant),
``Fn``    a closure, applied by building columns.

A ``Rel`` inside the scope of a row is correlated: ``pk`` are its columns that
match ``outer`` columns of that scope, so per-row collections stay relational
(joins, windows, aggregates) and are nested only where a result asks for it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.language.lexer import QueryError

_ids = itertools.count()


def fresh(stem: str) -> str:
    return f"__{stem}{next(_ids)}"


def sorting(order: tuple[tuple[Column, bool], ...]) -> list[Column]:
    """Sort columns of an order; of none, a constant (any order)."""
    return [c.desc() if down else c.asc() for c, down in order] or [F.lit(1)]


@dataclass
class Val:
    col: Column
    type: T.DataType | None = None
    links: dict[str, Any] = field(default_factory=dict)  # label -> Link
    literal: Any = None
    binders: tuple[str, ...] = ()


@dataclass
class Fn:
    params: tuple
    body: Any
    env: dict


@dataclass
class Link:
    """A traversal step attached to an element: how to reach its rows."""

    label: str
    key: Column  # of the element, matched with ``pk``
    make: Callable[[], Rel]  # rows with pk columns


@dataclass
class Rel:
    df: DataFrame
    elem: Val
    env: dict[str, Any] = field(default_factory=dict)  # binders over the rows
    pk: tuple[str, ...] = ()
    outer: tuple[Column, ...] = ()
    order: tuple[tuple[Column, bool], ...] = ()  # (key, descending)
    names: tuple[str, ...] = ()  # binders of the current element
    iterating: bool = False
    group: Any = None  # GroupScope of members that aggregates can be fused into
    cond: Column | None = None  # of fused members
    group_scope: Any = None  # groups that are not built yet
    following: Link | None = None  # a link that the next selector walks
    walked_as: str | None = None  # the binder of what it reaches

    def but(self, **changes) -> Rel:
        return replace(self, **changes)


class Scope:
    """Rows under evaluation; joins that expressions need are added to ``df``."""

    is_unit = False  # the one row that a whole query's value is computed on
    joins = False  # aggregates are joined to it, so that closures may use them

    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def attach(self, rel: Rel, right: DataFrame, names: list[str]) -> None:
        """Left join of one row for each key of a correlated relation."""
        keys = [fresh("k") for _ in rel.pk]
        right = right.select(*(F.col(p).alias(k) for p, k in zip(rel.pk, keys, strict=True)), *names)
        on = [o == F.col(k) for o, k in zip(rel.outer, keys, strict=True)]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        self.df = self.df.join(right, cond, "left").drop(*keys)

    def reduce(self, rel: Rel, aggs: list[Column], array: bool = False) -> list[Column]:
        """Aggregates of a relation as columns of these rows.  Arrays are joined
        (one row), as higher-order functions can't hold subqueries."""
        names = [fresh("a") for _ in aggs]
        named = [a.alias(n) for a, n in zip(aggs, names, strict=True)]
        if not rel.pk:
            one = rel.df.agg(*named)
            if array or self.joins:
                self.df = self.df.crossJoin(F.broadcast(one))  # one row
                return [F.col(n) for n in names]
            if len(names) == 1:
                return [one.scalar()]
            packed = one.select(F.struct(*names).alias("s")).scalar()
            return [packed[n] for n in names]
        self.attach(rel, rel.df.groupBy(*rel.pk).agg(*named), names)
        return [F.col(n) for n in names]

    def matches(self, rel: Rel) -> Column:
        """Whether the relation has rows for this one, as a flag."""
        if not rel.pk:
            return rel.df.limit(1).agg(F.count("*") > 0).scalar()
        flag = fresh("m")
        self.attach(rel, rel.df.select(*rel.pk).distinct().withColumn(flag, F.lit(True)), [flag])
        return F.coalesce(F.col(flag), F.lit(False))

    def type_of(self, v: Val) -> T.DataType:
        if v.type is None:
            v.type = self.df.select(v.col.alias("x")).schema["x"].dataType
        return v.type


class GroupScope(Scope):
    """Groups before they are made: aggregates of members are collected and
    computed in one aggregation; what can't be fused is joined by key."""

    def __init__(self, rel: Rel, keys: list[tuple[str, Val]]):
        names = [fresh("g") for _ in keys]
        self.base = rel.df.withColumns({n: v.col for n, (_, v) in zip(names, keys, strict=True)})
        self.keys, self.names = names, [k for k, _ in keys]
        self.types = [self.base.schema[n].dataType for n in names]
        self.aggs: list[Column] = []
        self.steps: list[Callable[[DataFrame], DataFrame]] = []
        self.built: DataFrame | None = None
        self.rel = rel

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    @property
    def df(self) -> DataFrame:
        return self.build()

    @df.setter
    def df(self, _: DataFrame) -> None:
        raise QueryError("groups are made once")

    def members(self) -> Rel:
        return self.rel.but(df=self.base, pk=tuple(self.keys), outer=tuple(F.col(k) for k in self.keys), group=self, order=self.rel.order)

    def reduce(self, rel: Rel, aggs: list[Column], array: bool = False) -> list[Column]:
        if rel.group is self and self.built is None:
            names = [fresh("a") for _ in aggs]
            self.aggs += [a.alias(n) for a, n in zip(aggs, names, strict=True)]
            return [F.col(n) for n in names]
        if not rel.pk:
            names = [fresh("a") for _ in aggs]
            one = rel.df.agg(*(a.alias(n) for a, n in zip(aggs, names, strict=True)))
            self.steps.append(lambda df: df.crossJoin(F.broadcast(one)))  # one row
            return [F.col(n) for n in names]
        names = [fresh("a") for _ in aggs]
        right = rel.df.groupBy(*rel.pk).agg(*(a.alias(n) for a, n in zip(aggs, names, strict=True)))
        self.attach(rel, right, names)
        return [F.col(n) for n in names]

    def attach(self, rel: Rel, right: DataFrame, names: list[str]) -> None:
        keys = [fresh("k") for _ in rel.pk]
        right = right.select(*(F.col(p).alias(k) for p, k in zip(rel.pk, keys, strict=True)), *names)

        def step(df: DataFrame) -> DataFrame:
            cond = None
            for o, k in zip(rel.outer, keys, strict=True):
                one = o.eqNullSafe(F.col(k))
                cond = one if cond is None else cond & one
            return df.join(right, cond, "left").drop(*keys)

        self.steps.append(step)

    def build(self) -> DataFrame:
        if self.built is None:
            df = self.base.groupBy(*self.keys).agg(*(self.aggs or [F.count("*").alias(fresh("a"))]))
            for step in self.steps:
                df = step(df)
            self.built = df
        return self.built

    def type_of(self, v: Val) -> T.DataType | None:
        return v.type
