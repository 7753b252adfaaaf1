"""Helpers shared by the operators: shared storage, word expressions, let-binding."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts, as a Java character class body.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see (spark.checkpoint.dir).

    A temporary local folder is chosen only where the setting is absent and all
    runs in one process, as in tests; on a cluster the setting is needed.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str, into: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage so that
    a lost executor costs a re-read, not a recomputation.

    The folder is noted in ``into``, or else in the innermost scratch().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    for noted in [into] if into is not None else _scratch[-1:]:
        noted.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders staged in each open scratch().
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Folders that are staged inside are removed at the end, also after a failure.

    What is used later must have been written elsewhere before.
    """
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        discard(spark, _scratch.pop())


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders of the shared storage."""
    for path in paths:
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


#: A key of more than one in so many rows is joined by broadcast; there are fewer such keys than this.
HOT = 500


def join_hot(rows: DataFrame, one: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """``rows`` (about ``n``) joined with ``one``, a staged table with a row for
    each key and its number ``c`` of rows.  Keys of over n / HOT rows are joined
    by broadcast, so the rows of a hub stay where they are."""
    hot = one.where(F.col("c") > n // HOT).drop("c")
    if hot.isEmpty():
        return rows.join(one.drop("c"), key, how)
    cold = one.where(F.col("c") <= n // HOT).drop("c")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A lambda variable is bound to the value, so the optimizer cannot inline an
    expensive expression (a split, a hash array) into every element of a
    nested higher-order function.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text; null gives an empty array."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{SPACE}]+"))


def n_words(text: Column) -> Column:
    """Number of words without building a filtered array."""
    t = F.coalesce(text, F.lit(""))
    edge = lambda c: F.when(c.isin(" ", "\t", "\n", "\x0b", "\x0c", "\r"), 1).otherwise(0)
    n = F.size(F.split(t, f"[{SPACE}]+")) - edge(F.substring(t, 1, 1)) - edge(F.substring(t, -1, 1))
    return F.when(t == "", F.lit(0)).otherwise(n).cast("long")
