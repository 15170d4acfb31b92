"""Results that are used more than once: written to the shared folder, which cuts their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and checkpointed where all executors can read them.

    The folder is the cluster's ``spark.checkpoint.dir``; only a local session without one gets its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="scenemill-"))
    return df.checkpoint()
