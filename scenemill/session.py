"""The session that the engine expects: UTC, ANSI, AQE and Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What every session of the engine sets; sizes that depend on the cluster stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM never compiles methods of more bytes: such a stage is faster as operators of their own
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build(app: str = "scenemill", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword settings use ``__`` for dots (``spark__ui__enabled``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
