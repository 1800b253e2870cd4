"""Spark session defaults and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app_name: str = "slipway", *, master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` uses ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Of a key given twice in a JSON object the last counts, as in Python.
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        # Whole source files go to Python in batches of bounded size, not of 10,000 files.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master gets a temporary folder when none is set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    if named or context.getCheckpointDir():
        return named or context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="slipway-"))
    return context.getCheckpointDir()
