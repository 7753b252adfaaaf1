from __future__ import annotations

from tessera.streaming import deduplicated, session_counts, window_counts

SCHEMA = "ts timestamp, user int, value double"


def test_windows_and_sessions(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1, 1.0), ("2024-01-01 00:01:00", 1, 2.0), ("2024-01-01 00:20:00", 1, 4.0), ("2024-01-01 00:02:00", 2, 8.0)]
    batch = spark.createDataFrame(rows, "t string, user int, value double").selectExpr("cast(t as timestamp) as ts", "user", "value")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = window_counts(stream, "ts", "10 minutes", ["user"], "value").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["user"], r["n"], r["total"]) for r in spark.sql("select * from windows").collect()) == [(1, 1, 4.0), (1, 2, 3.0), (2, 1, 8.0)]
    assert sorted((r["user"], r["n"]) for r in session_counts(batch, "ts", "5 minutes", ["user"]).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert deduplicated(batch, "ts", ["user"]).count() == 2
