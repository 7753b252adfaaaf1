"""Type names to tables: document collections and edge collections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.language.lexer import QueryError


@dataclass(frozen=True)
class Table:
    """A collection; an edge collection names its endpoint columns."""

    name: str
    df: DataFrame
    id: str | None = None
    source: str | None = None
    target: str | None = None

    @property
    def is_edge(self) -> bool:
        return self.source is not None

    def edges(self) -> DataFrame:
        """The rows with ``_from`` and ``_to`` added."""
        if not self.is_edge:
            raise QueryError(f"{self.name} is no edge collection")
        return self.df.withColumns({"_from": F.col(self.source), "_to": F.col(self.target)})


class Catalog:
    """Snapshots of tables by type name; mutations put new snapshots in place."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table | Callable[[], Table]] = {}

    def node(self, name: str, df: DataFrame, id: str) -> Catalog:
        self.tables[name] = Table(name, df, id)
        return self

    def edge(self, name: str, df: DataFrame, source: str, target: str) -> Catalog:
        self.tables[name] = Table(name, df, None, source, target)
        return self

    def lazy(self, name: str, load: Callable[[], DataFrame], id: str | None = None, source: str | None = None, target: str | None = None) -> Catalog:
        """A collection that is opened when a query first names it."""
        self.tables[name] = lambda: Table(name, load(), id, source, target)
        return self

    def replace(self, name: str, df: DataFrame) -> None:
        self.tables[name] = replace(self[name], df=df)

    def opened(self) -> list[Table]:
        return [t for t in self.tables.values() if isinstance(t, Table)]

    def __getitem__(self, name: str) -> Table:
        if name not in self.tables:
            raise QueryError(f"unknown type {name}; known: {', '.join(sorted(self.tables))}")
        if not isinstance(self.tables[name], Table):
            self.tables[name] = self.tables[name]()
        return self.tables[name]


def read(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Any source Spark reads: parquet, json, csv, orc, jdbc, ..."""
    return spark.read.format(fmt).options(**options).load(path)


#: Node collections of the standard tables: type, table, id.
NODES = [
    ("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"),
    ("Order", "orders", "o_orderkey"), ("Event", "events", "event_id"), ("Document", "documents", "doc_id"), ("Label", "labels", "doc_id"), ("Embedding", "embeddings", "vec_id"),
    ("Page", "pages", "page_id"), ("BenchmarkItem", "benchmark", "item_id"), ("Turn", "conversations", "conv_id"), ("Lineitem", "lineitem", "l_orderkey"),
]
#: Edge collections: type, table, _from, _to.
EDGES = [
    ("CustomerPlacesOrder", "orders", "o_custkey", "o_orderkey"), ("OrderContainsPart", "lineitem", "l_orderkey", "l_partkey"), ("SupplierShipsPart", "lineitem", "l_suppkey", "l_partkey"),
    ("CustomerInNation", "customer", "c_custkey", "c_nationkey"), ("SupplierInNation", "supplier", "s_suppkey", "s_nationkey"), ("NationInRegion", "nation", "n_nationkey", "n_regionkey"),
    ("CustomerDidEvent", "events", "user_id", "event_id"), ("DocumentHasLabel", "labels", "doc_id", "doc_id"),
]


def standard(spark: SparkSession, sf_dir: str) -> Catalog:
    """The standard tables as a document graph."""
    cat = Catalog(spark)
    load = cache(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    for name, table, key in NODES:
        cat.lazy(name, lambda t=table: load(t), key)
    for name, table, source, target in EDGES:
        cat.lazy(name, lambda t=table: load(t), None, source, target)

    def neighbours() -> DataFrame:
        n = load("nation")
        a, b = n.select(F.col("n_nationkey").alias("_from"), F.col("n_regionkey").alias("r")), n.select(F.col("n_nationkey").alias("_to"), F.col("n_regionkey").alias("r"))
        return a.join(b, "r").where("_from <> _to").select("_from", "_to")

    return cat.lazy("NationNeighbours", neighbours, None, "_from", "_to")
