"""Profiles of tables, degenerate columns, and drift between two profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that count as missing in a profile, after trimming and lower-casing.
MISSING = ("", "na", "nan", "null", "none", "n/a")
#: Distinct values are counted exactly up to this many; beyond it the count is null.
MAX_DISTINCT = 1000


def _is_missing(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return c.isNull() | F.lower(F.trim(c)).isin(*MISSING)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _as_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(c.alias("v")))
    return F.trim(c) if isinstance(kind, T.StringType) else c.cast("string")


def _number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        clean = F.trim(c)
        number = F.when(clean.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), clean.try_cast("double"))
        return F.when(clean.rlike(r"(?i)^\+?inf(?:inity)?$"), F.lit(float("inf"))).when(clean.rlike(r"(?i)^-inf(?:inity)?$"), F.lit(float("-inf"))).otherwise(number)
    return F.lit(None).cast("double")


#: What an order of rows is made of where the rows have none of their own.
PLACE = "_place"


def profile(table: DataFrame, order: str | None = None, max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """``column, rows, nulls, distinct, min, max, col_hash`` of every column.

    One pass of aggregates that combine before the shuffle. Distinct values come from a sketch first; only
    columns that it puts near or below the cap are counted exactly, in a second aggregate over those few.
    ``col_hash`` is a sum over rows of hashes of the value with its place, so a column whose values stand in another
    order has another hash, and equal columns have equal ones. The place of a row is ``order``, a unique column such
    as a line number or a key, which is profiled too; without it the hash of the whole row stands for the place. Columns of any type are profiled, nested ones by their JSON text. An empty table has one
    row per column with zeros.
    """
    fields = [f for f in table.schema.fields]
    place = F.col(f"`{order}`").cast("string") if order else F.to_json(F.struct(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)]))
    table = table.withColumn(PLACE, F.xxhash64(place))
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        missing, value, number = _is_missing(c, f.dataType), _as_text(c, f.dataType), _number(c, f.dataType)
        number = F.when(~F.isnan(number), number)
        aggregates += [
            F.count_if(missing).alias(f"nulls_{i}"), F.approx_count_distinct(F.when(~missing, value), 0.02).alias(f"about_{i}"), F.min(number).alias(f"min_{i}"), F.max(number).alias(f"max_{i}"),
            F.sum(F.xxhash64(PLACE, F.coalesce(value, F.lit(""))).cast("decimal(38,0)")).alias(f"hash_{i}"),
        ]
    first = table.agg(*aggregates).collect()[0]
    few = [i for i in range(len(fields)) if first[f"about_{i}"] <= max_distinct * 1.2]
    exact = {}
    if few:
        counts = [F.size(F.collect_set(F.when(~_is_missing(F.col(f"`{fields[i].name}`"), fields[i].dataType), _as_text(F.col(f"`{fields[i].name}`"), fields[i].dataType)))).alias(f"d_{i}") for i in few]
        exact = table.agg(*counts).collect()[0].asDict()
    rows = []
    for i, f in enumerate(fields):
        distinct = exact.get(f"d_{i}")
        digest = "%016x" % (int(first[f"hash_{i}"] or 0) % (1 << 64))
        rows.append((f.name, i, first["rows"], first[f"nulls_{i}"], distinct if distinct is not None and distinct <= max_distinct else None, first[f"min_{i}"], first[f"max_{i}"], digest))
    return table.sparkSession.createDataFrame(rows, "column string, place int, rows bigint, nulls bigint, distinct int, min double, max double, col_hash string")


def degeneracies(profiled: DataFrame) -> DataFrame:
    """``column, problem``: ALL-NULL before >50% NULL before CONSTANT, and DUPLICATES of an earlier column."""
    filled = F.col("rows") - F.col("nulls")
    problem = (
        F.when((F.col("rows") > 0) & (filled == 0), "ALL-NULL").when(F.col("nulls") > 0.5 * F.col("rows"), ">50% NULL")
        .when((filled >= 2) & (F.col("distinct") == 1), "CONSTANT")
    )
    single = profiled.select("column", problem.alias("problem")).filter("problem is not null")
    first = profiled.filter("rows > 0").groupBy("col_hash").agg(F.min_by("column", "place").alias("_first"))
    twice = profiled.join(first, "col_hash").filter(F.col("column") != F.col("_first")).select("column", F.concat(F.lit("DUPLICATES "), "_first").alias("problem"))
    return single.unionByName(twice)


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """``column, severity, change`` between two profiles: hard for lost or new columns, order, row count, more nulls and collapse to a constant, soft for fewer nulls and other content."""
    a = old.select("column", *[F.col(c).alias(f"{c}_a") for c in ("place", "rows", "nulls", "distinct", "col_hash")])
    b = new.select("column", *[F.col(c).alias(f"{c}_b") for c in ("place", "rows", "nulls", "distinct", "col_hash")])
    both = a.join(b, "column", "full_outer")
    there = F.col("place_a").isNotNull() & F.col("place_b").isNotNull()
    rule = lambda cond, severity, change: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(change).alias("change")))
    found = F.array_compact(F.array(
        rule(F.col("place_b").isNull(), "hard", "column gone"), rule(F.col("place_a").isNull(), "hard", "column added"), rule(there & (F.col("place_a") != F.col("place_b")), "hard", "column moved"),
        rule(there & (F.col("rows_a") != F.col("rows_b")), "hard", "row count changed"), rule(there & (F.col("nulls_b") > F.col("nulls_a")), "hard", "more nulls"),
        rule(there & ~F.col("distinct_a").eqNullSafe(F.lit(1)) & F.col("distinct_b").eqNullSafe(F.lit(1)), "hard", "collapsed to a constant"),
        rule(there & (F.col("nulls_b") < F.col("nulls_a")), "soft", "fewer nulls"), rule(there & (F.col("col_hash_a") != F.col("col_hash_b")), "soft", "content changed"),
    ))
    return both.select("column", F.inline(found))


def array_profile(table: DataFrame, column: str) -> DataFrame:
    """``rows, width, nans, min, max, constant`` of an array column, as of a matrix."""
    c = F.col(column)
    good = F.filter(c, lambda x: x.isNotNull() & ~F.isnan(x))
    flat = table.select(F.size(c).alias("w"), (F.size(c) - F.size(good)).alias("bad"), F.array_min(good).alias("lo"), F.array_max(good).alias("hi"))
    agg = flat.agg(F.count(F.lit(1)).alias("rows"), F.max("w").alias("width"), F.sum("bad").alias("nans"), F.min("lo").cast("double").alias("min"), F.max("hi").cast("double").alias("max"))
    return agg.withColumn("constant", F.col("min") == F.col("max"))


def verify(old: DataFrame, new: DataFrame) -> DataFrame:
    """``file, severity, why`` over profiles of many files, each with a column ``file`` beside those of ``profile`` and ``sha256``.

    A file that is gone FAILs, a new one warns, hard drift FAILs, soft drift warns, and a degenerate column FAILs
    even in a file with the same content. Files with equal ``sha256`` have no drift.
    """
    a, b = old.select("file", F.col("sha256").alias("_a")).distinct(), new.select("file", F.col("sha256").alias("_b")).distinct()
    files = a.join(b, "file", "full_outer")
    moved = files.filter("_a is null or _b is null").select("file", F.when(F.col("_b").isNull(), "FAIL").otherwise("warn").alias("severity"), F.when(F.col("_b").isNull(), "missing").otherwise("new file").alias("why"))
    changed = files.filter("_a <> _b").select("file")
    both = lambda d: d.join(changed, "file").withColumn("column", F.concat_ws("\u001f", "file", "column"))
    drifted = drift(both(old), both(new)).select(F.split_part("column", F.lit("\u001f"), F.lit(1)).alias("file"), F.when(F.col("severity") == "hard", "FAIL").otherwise("warn").alias("severity"), F.concat_ws(": ", F.split_part("column", F.lit("\u001f"), F.lit(2)), "change").alias("why"))
    apart = new.withColumns({"column": F.concat_ws("\u001f", "file", "column"), "col_hash": F.concat_ws("\u001f", "file", "col_hash")})
    poor = degeneracies(apart).select(F.split_part("column", F.lit("\u001f"), F.lit(1)).alias("file"), F.lit("FAIL").alias("severity"), F.concat_ws(": ", F.split_part("column", F.lit("\u001f"), F.lit(2)), F.regexp_replace("problem", "[^ ]*\u001f", "")).alias("why"))
    return moved.unionByName(drifted).unionByName(poor)


def array_problems(profiled: DataFrame) -> DataFrame:
    """``path, problem`` of array files (``path, nans, constant``): CONSTANT, and how many NaN there are."""
    found = F.array_compact(F.array(F.when(F.col("constant"), F.lit("CONSTANT")), F.when(F.col("nans") > 0, F.concat(F.col("nans").cast("string"), F.lit(" NaN")))))
    return profiled.select("path", F.explode(found).alias("problem"))


def array_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, severity, change`` between two profiles of array files: another shape or type and more NaN are hard."""
    fields = ("shape", "dtype", "nans")
    a, b = (d.select("path", *[F.col(c).alias(f"{c}_{s}") for c in fields]) for d, s in ((old, "a"), (new, "b")))
    rule = lambda condition, change: F.when(condition, F.struct(F.lit("hard").alias("severity"), change.alias("change")))
    said = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"{c}_a").cast("string"), F.lit("None")), F.lit(" -> "), F.coalesce(F.col(f"{c}_b").cast("string"), F.lit("None")))
    more = F.col("nans_a").isNotNull() & (F.coalesce("nans_b", F.lit(0)) > F.col("nans_a"))
    found = F.array_compact(F.array(*[rule(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), said(c)) for c in ("shape", "dtype")], rule(more, said("nans"))))
    return a.join(b, "path").select("path", F.inline(found))
