"""Queries that once ran on a subset of ids have a form over every row."""

from __future__ import annotations

import os

import pytest

from tessera.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_fold_covers_every_customer(spark):
    want = {r["c_custkey"]: 0 for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    for r in sorted(spark.read.parquet(f"{SF}/orders.parquet").collect(), key=lambda r: r["o_orderkey"]):
        want[r["o_custkey"]] = want[r["o_custkey"]] * 3 % 1000 + r["o_orderkey"]
    assert {r["id"]: r["v"] for r in QUERIES["fold_sum"](spark, SF).collect()} == want


@pytest.mark.parametrize(("name", "table", "times"), [("flatten_depth2", "orders", 3), ("json_field", "events", 1)])
def test_no_row_is_left_out(spark, name, table, times):
    assert QUERIES[name](spark, SF).count() == times * spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_closure_starts_everywhere(spark):
    got = QUERIES["transitive_closure"](spark, SF).collect()
    region = {r["n_nationkey"]: r["n_regionkey"] for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    assert sorted(map(tuple, got)) == sorted((a, b) for a in region for b in region if region[a] == region[b])
