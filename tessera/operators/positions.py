"""Positions in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.shared import cut


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's 0-based position (long) in ``order``.

    The rows are range-sorted and checkpointed, which fixes their partitions; a
    row's position is the number of rows in earlier partitions, one number for
    each partition, plus its place in its own.
    """
    rows = cut(df.orderBy(*order) if order else df)
    marked = rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = marked.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return marked.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def sums_before(df: DataFrame, order: list[Column], weight: str, name: str) -> DataFrame:
    """Adds the sum of ``weight`` (long) over the rows before each one in ``order``, as ``numbered`` adds their number."""
    rows = cut(df.orderBy(*order))
    marked = rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy("__part").agg(F.sum(weight).alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before(Window.orderBy("__part"))), F.lit(0)).alias("__start"))
    own = F.coalesce(F.sum(weight).over(before(Window.partitionBy("__part").orderBy("__at"))), F.lit(0))
    return marked.withColumn("__own", own).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__own")).drop("__part", "__at", "__own", "__start")


def ranks(df: DataFrame, order: list[tuple[Column, bool]], keys: list[str], position: str, rank: str, dense: str) -> DataFrame:
    """Adds rank and dense rank (from 1) by ``keys`` to numbered rows.

    A key's rank is its first position, its dense rank its place among the
    distinct keys, so one aggregation and one join serve for the window.
    """
    first = df.groupBy(*keys).agg((F.min(position) + 1).alias(rank))
    placed = numbered(first, [c.desc() if down else c.asc() for c, down in order], dense).withColumn(dense, F.col(dense) + 1)
    other = placed.withColumnsRenamed({k: f"{k}_of" for k in keys})
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"{k}_of"))
        on = one if on is None else on & one
    return df.join(other, on).drop(*(f"{k}_of" for k in keys))
