"""Session set-up and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tipoff", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate files.

    It is the one the cluster names in `spark.checkpoint.dir`. Only a local session without that setting gets
    a folder of its own; a cluster session without it is an error, because files on one machine do not
    survive the loss of that machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tipoff-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder so that every later read sees the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(df: DataFrame) -> int:
    """Number of shuffle partitions the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
