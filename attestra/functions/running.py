"""Running sums over large groups without a single task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.session import cut_lineage


def running_sum(rows: DataFrame, keys: list[str], part: str, order: list[str], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` up to and with each row, within ``keys``, in order of ``part`` then ``order``.

    ``part`` must be a coarse order of the rows with parts of bounded size. Sums of parts come first, their
    running totals next, exact sums inside each part last.
    """
    sums = rows.groupBy(*keys, part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_inside", F.sum(value).over(inside)).join(offsets, [*keys, part]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_inside", "_before")


def numbered(rows: DataFrame, order: list[Column | str], out: str, keys: list[str] | None = None) -> DataFrame:
    """``out``: the place of each row from 1, in order, within ``keys`` or over all; rows are written to the shared folder.

    Rows are range-partitioned by the whole order, which must end in something unique, so neither a key that holds a
    third of all rows nor a value that many rows share is a single task. The ranges are drawn from a sample, so they
    are written once and then counted.
    """
    held = [F.col(k) for k in keys or []]
    ranged = cut_lineage(rows.repartitionByRange(*held, *order).withColumns({"_part": F.spark_partition_id(), "_one": F.lit(1), "_all": F.lit(0)}))
    return running_sum(ranged, keys or ["_all"], "_part", order, "_one", out).drop("_part", "_one", "_all")
