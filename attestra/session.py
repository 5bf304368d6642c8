"""Session set-up and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "attestra", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the library expects of any session.

    On a cluster the session comes from the cluster; only time zone and AQE matter.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder of the cluster and return it without lineage.

    The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset and Spark runs in
    one process, as in tests, a temporary folder is set, which goes when the process ends; a cluster without the setting is an error.
    Checkpoint files survive the loss of executors. What was shuffled to make them is deleted at once, not when the driver's
    garbage happens to be collected.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not shared:
            shared = tempfile.mkdtemp(prefix="attestra-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        once = df.select("*")  # a query of its own, so that none but the checkpoint reads its shuffles
    finally:
        conf.set(name, before)
    return once.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
