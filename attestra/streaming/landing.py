"""Structured Streaming forms of the incremental operators: landing results, log tail, watch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestra.operators import study
from attestra.sources.files import LOG, RUN


def landing_runs(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """Result files as they land; unreadable ones are passed over until they are whole in a new file."""
    raw = spark.readStream.schema(RUN).option("multiLine", True).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", most_files).json(folder)
    return raw.withColumn("path", F.input_file_name()).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def keep_newest(runs: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("notebook", "span_start", "seed")) -> StreamingQuery:
    """Newest run of each key in versions of ``target``, one folder a batch, so a batch can be repeated.

    A batch reads the version before it and writes its own; ``latest_version`` finds the last whole one.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        before = latest_version(batch.sparkSession, target, below=number)
        both = batch if before is None else before.unionByName(batch)
        study.supersede(both, keys).write.mode("overwrite").parquet(os.path.join(target, f"v{number:012d}"))

    return runs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The last complete version under ``target``, or None."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    found = []
    for status in system.listStatus(path):
        name = status.getPath().getName()
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(target, name, "_SUCCESS"))
        if name.startswith("v") and name[1:].isdigit() and (below is None or int(name[1:]) < below) and system.exists(done):
            found.append(name)
    return spark.read.parquet(os.path.join(target, max(found))) if found else None


def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Last entry of each track of a growing log, for complete mode."""
    raw = spark.readStream.schema(LOG).json(folder).filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop("_corrupt_record")
    return raw.groupBy("track").agg(F.max_by(F.struct("id", "type", "text"), "id").alias("e")).select("track", "e.*")


def watch(hits: DataFrame, store: DataFrame) -> DataFrame:
    """Papers of a stream that the store lacks, each once."""
    return hits.dropDuplicates(["paperid"]).join(store.select("paperid").distinct(), "paperid", "left_anti")


def counts_by_window(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension beside the batch operators: counts by tumbling window and type, late rows up to ``late``."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
