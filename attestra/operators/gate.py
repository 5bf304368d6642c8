"""One verdict over many findings, and frozen snapshots of content."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def verdict(checks: DataFrame) -> DataFrame:
    """One row ``ready, failed, warned`` from ``name, required, ok``; a null ``required`` is required."""
    must = F.coalesce("required", F.lit(True))
    return checks.agg((F.count_if(~F.col("ok") & must) == 0).alias("ready"), F.count_if(~F.col("ok") & must).alias("failed"), F.count_if(~F.col("ok") & ~must).alias("warned"))


def steps(named: dict[str, tuple[DataFrame, bool]]) -> DataFrame:
    """``name, required, ok, findings``: a step is ok if its findings have no row."""
    rows = [found.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(name).alias("name"), F.lit(required).alias("required"), (F.col("findings") == 0).alias("ok"), "findings") for name, (found, required) in named.items()]
    return reduce(DataFrame.unionByName, rows)


def row_freeze(table: DataFrame, key: str) -> DataFrame:
    """``key, sha256`` of every row over the JSON text of its columns in order of their names."""
    rest = sorted(c for c in table.columns if c != key)
    return table.select(F.col(key).alias("key"), F.sha2(F.to_json(F.struct(*rest)), 256).alias("sha256"))


def text_freeze(table: DataFrame, key: str, column: Column) -> DataFrame:
    return table.select(F.col(key).alias("key"), F.sha2(column, 256).alias("sha256"))


def verify_freeze(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """``key, state`` of each frozen key: ok, CHANGED or MISSING; new keys are ignored."""
    now = current.select("key", F.col("sha256").alias("_now"), F.lit(True).alias("_there"))
    both = frozen.join(now, "key", "left")
    return both.select("key", F.when(F.col("_there").isNull(), "MISSING").when(F.col("sha256").eqNullSafe(F.col("_now")), "ok").otherwise("CHANGED").alias("state"))


def run_steps(spark: SparkSession, checks: dict[str, tuple[Callable[[], DataFrame], bool]]) -> DataFrame:
    """``name, required, ok, tail, secs`` of in-process checks, each a callable that gives its findings.

    A check is ok if it has no finding; one that raises is not, and ``tail`` says why. The checks run one after
    the other, as they are few.
    """
    rows = []
    for name, (check, required) in checks.items():
        began = time.monotonic()
        try:
            findings = check().limit(8).collect()
            ok, tail = not findings, "\n".join(str(r) for r in findings)
        except Exception as error:  # noqa: BLE001 - a failing check must not stop the gate
            ok, tail = False, f"{type(error).__name__}: {error}"[:2000]
        rows.append((name, required, ok, tail, time.monotonic() - began))
    return spark.createDataFrame(rows, "name string, required boolean, ok boolean, tail string, secs double")
