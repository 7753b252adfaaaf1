"""Shared storage for iterative operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that all executors share (spark.checkpoint.dir).

    A local folder is taken only where none is set and all runs in one process,
    as in tests; on a cluster the setting is needed.

    Spark hands on what its optimizer proved of the columns (x = f(parent of x))
    and its guess of the size.  In a loop each round nests the last one's proof
    in its own, which doubles filters and generated code, so the result starts
    from the bare rows; adaptive execution knows their true size.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    kept = df.checkpoint()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), df.sparkSession)
