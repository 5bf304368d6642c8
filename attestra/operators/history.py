"""History of attributes with the period in which each version held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.forms import written_day

#: End of a period that is still open.
OPEN_END = "9999-12-31"


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Changed keys between two snapshots: the keys, ``change`` and the attributes before and after.

    A null-safe full outer join, so null keys match each other and null attributes differ from
    values but not from null. ``change`` is inserted, changed or deleted; equal rows give nothing.
    Columns are ``<attribute>_before`` and ``<attribute>_after``. Keys must be unique in a snapshot.
    """
    a = before.select(*[F.col(k).alias(f"_ka_{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"{c}_before") for c in attributes], F.lit(True).alias("_before"))
    b = after.select(*[F.col(k).alias(f"_kb_{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"{c}_after") for c in attributes], F.lit(True).alias("_after"))
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"_ka_{i}").eqNullSafe(F.col(f"_kb_{i}"))
    equal = F.lit(True)
    for c in attributes:
        equal = equal & F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    change = F.when(F.col("_before").isNull(), "inserted").when(F.col("_after").isNull(), "deleted").when(~equal, "changed")
    joined = a.join(b, same, "full_outer").withColumn("change", change).filter("change is not null")
    key_columns = [F.when(F.col("_after").isNull(), F.col(f"_ka_{i}")).otherwise(F.col(f"_kb_{i}")).alias(k) for i, k in enumerate(keys)]
    return joined.select(*key_columns, "change", *[f"{c}_{side}" for c in attributes for side in ("before", "after")])


def versions(observations: DataFrame, key: str, day: str, order: str, attributes: list[str]) -> DataFrame:
    """Every version of each key with ``valid_from`` and ``valid_to``, from dated observations.

    Of several observations of a key on one day the one with the greatest ``order`` counts; that
    reduction combines before the shuffle, so from there a key has at most one row for each day.
    Each key's observed days are its snapshots. Consecutive ones are compared by ``snapshot_diff``:
    the n-th observation of a key after against its (n-1)-th before. Inserted and changed rows begin
    a version and ``lead`` over them gives its end, ``OPEN_END`` for the last. Null attributes are
    values like others; null keys are one key; rows with a null day are ignored.
    """
    seen = observations.filter(F.col(day).isNotNull()).groupBy(key, day).agg(F.max_by(F.struct(*attributes), F.col(order)).alias("_v"))
    per_key = Window.partitionBy(key).orderBy(day)
    numbered = seen.select(key, day, *[F.col(f"_v.{c}").alias(c) for c in attributes], F.row_number().over(per_key).alias("_n"))
    stated = [*attributes, day]
    following = numbered.withColumn("_n", F.col("_n") + 1).select(key, "_n", *stated)
    events = snapshot_diff_events(following, numbered.select(key, "_n", *stated), [key, "_n"], attributes, day)
    after = Window.partitionBy(key).orderBy("valid_from")
    return events.select(key, *attributes, "valid_from", F.coalesce(F.lead("valid_from").over(after), F.lit(OPEN_END)).alias("valid_to"))


def snapshot_diff_events(before: DataFrame, after: DataFrame, keys: list[str], attributes: list[str], day: str) -> DataFrame:
    """The versions that begin between two snapshots: first key, attributes and ``valid_from``.

    The day takes part in the comparison only as a value to carry: a row counts as changed by its
    attributes alone. Deleted keys begin no version, they only end the sequence of their key.
    """
    diff = snapshot_diff(before, after, keys, [*attributes, day])
    differs = F.lit(False)
    for c in attributes:
        differs = differs | ~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    begun = diff.filter((F.col("change") == "inserted") | ((F.col("change") == "changed") & differs))
    return begun.select(keys[0], *[F.col(f"{c}_after").alias(c) for c in attributes], F.col(f"{day}_after").alias("valid_from"))


def snapshot_changes(snapshots: DataFrame, key: str, snapshot: str, attributes: list[str]) -> DataFrame:
    """``<key>, <snapshot>, change`` and the attributes before and after, of all consecutive dated snapshots.

    ``snapshots`` has one row for each key and snapshot; snapshots are consecutive whole numbers, of which those
    without any row count as empty. All pairs of neighbours are compared by one null-safe full outer join. A key of the
    first snapshot is inserted there; one that the next snapshot lacks is deleted in it, unless there is none.
    """
    rows = snapshots.filter(F.col(snapshot).isNotNull()).select(key, snapshot, *attributes)
    last = F.broadcast(rows.agg(F.max(snapshot).alias("_last")))  # a single row
    before = rows.crossJoin(last).filter(F.col(snapshot) < F.col("_last")).withColumn(snapshot, F.col(snapshot) + 1).drop("_last")
    return snapshot_diff(before, rows, [key, snapshot], attributes)


def change_log(history: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Change events of a history: key, day, ``change`` (inserted or changed) and the attributes before and after."""
    per_key = Window.partitionBy(key).orderBy("valid_from")
    before: list[Column] = [F.lag(c).over(per_key).alias(f"{c}_before") for c in attributes]
    change = F.when(F.row_number().over(per_key) == 1, "inserted").otherwise("changed")
    return history.select(key, F.col("valid_from").alias("day"), change.alias("change"), *before, *[F.col(c).alias(f"{c}_after") for c in attributes])


def as_of(history: DataFrame, day: str) -> DataFrame:
    """The versions that held on a day, given as ``YYYY-MM-DD``."""
    return history.filter((F.col("valid_from") <= day) & (F.lit(day) < F.col("valid_to")))


def citation_history(papers: DataFrame) -> DataFrame:
    """Citation counts of each paper by the day of fetching: ``paperid, citationcount, valid_from, valid_to``.

    Rows whose ``_fetched`` names no day, whose count is null or negative, or whose ``paperid`` is
    null are no observations.
    """
    seen = papers.select("paperid", "row_id", "citationcount", written_day(F.col("_fetched")).alias("day"))
    seen = seen.filter(F.col("paperid").isNotNull() & F.col("day").isNotNull() & (F.col("citationcount") >= 0))
    return versions(seen, "paperid", "day", "row_id", ["citationcount"])


def monthly_counts(papers: DataFrame) -> DataFrame:
    """``paperid, month, citationcount``: what each month's fetches say last of each paper; months count from year 0."""
    seen = papers.select("paperid", "row_id", "citationcount", written_day(F.col("_fetched")).alias("day"))
    seen = seen.filter(F.col("paperid").isNotNull() & F.col("day").isNotNull() & (F.col("citationcount") >= 0))
    month = F.substring("day", 1, 4).cast("int") * 12 + F.substring("day", 6, 2).cast("int") - 1
    return seen.groupBy("paperid", month.alias("month")).agg(F.max_by("citationcount", F.struct("day", "row_id")).alias("citationcount"))
