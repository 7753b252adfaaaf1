"""Mutations as snapshot rewrites: every statement reads a snapshot of its
tables and puts a new DataFrame in the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def created(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows added, missing fields null, types those of the table."""
    return table.unionByName(conform(rows, table))


#: The fields that a new row names.
GIVEN = "__given"


def conform(rows: DataFrame, table: DataFrame, *more: str) -> DataFrame:
    """Rows in the table's columns and types, missing fields null; ``more`` are kept beside them."""
    have = set(rows.columns) - set(more)
    unknown = have - set(table.columns)
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema), *more)


def upserted(table: DataFrame, rows: DataFrame, keys: tuple[str, ...], action: str) -> DataFrame:
    """replace: the new row; merge: the fields that the new row names, none
    included, else the old; ignore: the old row.  Rows without a conflict are
    added.  A column GIVEN of ``rows`` lists the fields that each names; without
    it, all columns are."""
    given = F.col(GIVEN) if GIVEN in rows.columns else F.array(*(F.lit(c) for c in rows.columns))
    named = rows.withColumn("__named", given).drop(GIVEN)
    new = conform(rows.drop(GIVEN), table)
    if action == "replace":
        return table.join(new.select(*keys), list(keys), "left_anti").select(table.columns).unionByName(new)
    if action == "ignore":
        return table.unionByName(new.join(table.select(*keys), list(keys), "left_anti").select(table.columns))
    a, b = table.alias("a"), conform(named, table, "__named").alias("b")
    on = None
    for k in keys:
        one = F.col(f"a.{k}") == F.col(f"b.{k}")
        on = one if on is None else on & one
    pick = lambda c: F.when(F.array_contains("b.__named", c), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return a.join(b, on, "full_outer").select(*(pick(c).alias(c) for c in table.columns))


def updated(table: DataFrame, setters: list[tuple[tuple[str, ...], Column]], where: Column | None) -> DataFrame:
    """Fields set where the condition holds; nested fields by path."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    out = {}
    for path, value in setters:
        field = path[0]
        old = out.get(field, F.col(field))
        kind = table.schema[field].dataType
        if len(path) == 1:
            new = value.cast(kind)
        else:
            new = F.col(field).withField(".".join(path[1:]), value) if field not in out else out[field].withField(".".join(path[1:]), value)
        out[field] = F.when(hit, new).otherwise(old)
    return table.select(*(out[c].alias(c) if c in out else F.col(c) for c in table.columns))


def deleted(table: DataFrame, where: Column | None) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False))) if where is not None else table.limit(0)


def linked(edges: DataFrame, source: str, target: str, pairs: DataFrame) -> DataFrame:
    """Edges added for pairs (_from, _to, properties...); endpoint fields by name."""
    new = pairs.withColumnsRenamed({"_from": source, "_to": target})
    return edges.unionByName(conform(new, edges))


def unlinked(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Edges that match a row of ``matched`` in every field go."""
    on = None
    cols = edges.columns
    m = matched.distinct().select(*(F.col(c).alias(f"__{c}") for c in cols))
    for c in cols:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        on = one if on is None else on & one
    return edges.join(m, on, "left_anti")
