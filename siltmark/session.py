"""Session builder and the settings that every job in the package relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "siltmark", master: str | None = None, **conf: object) -> SparkSession:
    """Session with a UTC clock and adaptive execution, including skew joins.

    On a cluster pass no master: it comes from spark-submit, together with
    ``spark.sql.shuffle.partitions`` and ``spark.checkpoint.dir``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for ``DataFrame.checkpoint``: the cluster's own, a scratch one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="siltmark-ckpt-")
    sc.setCheckpointDir(named)
    return named
