"""Session helpers: how to start one, and where intermediate tables are cut off their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "plumbline", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings this library relies on; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
        "spark.ui.enabled": "false",
        **{k: str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh temporary one only where a local run names none."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once to the checkpoint folder and continue from there.

    Used where a result feeds several later branches or a driver loop: every branch then reads the same
    rows, the plan stays short, and a lost executor costs a re-read instead of a recomputation.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
