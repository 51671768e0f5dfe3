"""The folder that all executors share, for tables written between stages."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where none is set a temporary one serves a local session, as in tests; on a cluster,
    whose executors could not share it, that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='skein-')}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")
