"""One surviving record for each group of rows that describe the same thing.

Survivorship is decided field by field in a single aggregation: the maximum of a composite struct of
usability, source priority, time, a unique tie-breaker and the value. It combines partial results before the
shuffle, so a group that holds a third of all rows still reaches its final task as one row per input partition.
Values that are large, such as maps, stay out of the aggregation: their origin alone is decided, and the value is
fetched by it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.forms import instant, is_number, notebook_file, present, written_day


@dataclass(frozen=True)
class Rule:
    """How a field survives: is the value usable, source priority (greater wins), then the later time.

    ``large`` values are fetched by their origin after the aggregation.
    """

    value: Column
    usable: Column
    priority: list[Column] = field(default_factory=list)
    large: bool = False


def survivors(rows: DataFrame, keys: list[str], rules: Mapping[str, Rule], when: Column, record_id: Column, having: Column | None = None) -> DataFrame:
    """One row for each group: its keys, and for each rule ``<name>`` and ``<name>_from``.

    ``<name>`` is the value of the row whose (usable, priority, time, smallest ``record_id``) is
    greatest and ``<name>_from`` is that row's ``record_id``. Where no row is usable the value is
    null and so is its origin. Unknown times come last. ``record_id`` must be a unique number; where
    rows are stored twice, the copies have equal ranks and values, so the result stays the same.
    ``having`` is an aggregate condition on groups. Rows with a null key are in no group.
    """
    base = rows.dropna(subset=keys)
    staged = {"_id": record_id, "_time": when}
    for name, rule in rules.items():
        staged |= {f"_{name}_usable": rule.usable} | ({} if rule.large else {f"_{name}_value": rule.value}) | {f"_{name}_p{i}": p for i, p in enumerate(rule.priority)}
    flat = base.select(*keys, *[c.alias(n) for n, c in staged.items()])
    best = []
    for name, rule in rules.items():
        order = [F.col(f"_{name}_usable").alias("usable"), *[f"_{name}_p{i}" for i in range(len(rule.priority))], F.col("_time").isNotNull().alias("known"), "_time", (-F.col("_id")).alias("first")]
        best.append(F.max(F.struct(*order, *([] if rule.large else [F.col(f"_{name}_value").alias("value")]))).alias(f"_{name}"))
    grouped = flat.groupBy(*keys).agg(*best, *([having.alias("_having")] if having is not None else []))
    if having is not None:
        grouped = grouped.filter("_having")
    pairs = []
    for name, rule in rules.items():
        kept = lambda c, n=name: F.when(F.col(f"_{n}.usable"), c)
        pairs += ([] if rule.large else [kept(F.col(f"_{name}.value")).alias(name)]) + [kept(-F.col(f"_{name}.first")).alias(f"{name}_from")]
    out = grouped.select(*keys, *pairs)
    for name, rule in rules.items():
        if rule.large:
            # One of the copies of a row that is stored twice; only rows that survive are fetched.
            stored = base.select(record_id.alias("_origin"), rule.value.alias(name)).groupBy("_origin").agg(F.first(name).alias(name))
            out = out.join(stored, F.col(f"{name}_from") == F.col("_origin"), "left").drop("_origin")
    columns = [c for name in rules for c in (name, f"{name}_from")]
    return out.select(*keys, *columns)


def run_keys(results: DataFrame) -> DataFrame:
    """``results`` with the columns ``file``, ``span_day`` and ``seed`` that say which run a row is.

    ``span_day`` is ``''`` for every way to say that there is no span. A span that names no day
    keeps its trimmed text, so it groups with its like only.
    """
    span = F.coalesce(written_day(F.col("span_start")), present(F.col("span_start")), F.lit(""))
    return results.withColumn("file", notebook_file(F.col("notebook"))).withColumn("span_day", span)


def _usable_results() -> Column:
    return F.coalesce(F.exists(F.map_values("results")["mape"], is_number), F.lit(False))


def _smoke_rank() -> Column:
    """Full runs before unknown ones before smoke tests."""
    return F.when(~F.col("smoke_test"), 2).when(F.col("smoke_test").isNull(), 1).otherwise(0)


def surviving_rows(results: DataFrame) -> DataFrame:
    """``first_run_id`` and ``kept_run_id`` of each group of two or more rows of the same run.

    The surviving row is one with a configuration whose ``mape`` is a number, then not a smoke
    test, then the latest, then the smallest ``run_id``. The row as a whole is the one field here,
    always usable. A table without such groups gives an empty result.
    """
    keyed = run_keys(results)
    rule = Rule(F.col("run_id"), F.lit(True), [_usable_results(), _smoke_rank()])
    first = Rule(F.col("run_id"), F.lit(True), [-F.col("run_id")])
    kept = survivors(keyed, ["file", "span_day", "seed"], {"kept_run_id": rule, "first_run_id": first}, instant(F.col("timestamp_utc")), F.col("run_id"), having=F.count(F.lit(1)) > 1)
    return kept.select("first_run_id", "kept_run_id")


def golden_runs(results: DataFrame) -> DataFrame:
    """One record for each run, with the origin (``*_from``, a ``run_id``) of each value.

    Every group is there, also of one row. The fields are chosen on their own: path, smoke flag,
    span text, time text and the results, each from the best row that has a usable value.
    """
    keyed = run_keys(results)
    order = [_usable_results(), _smoke_rank()]
    text = lambda c: Rule(F.col(c), present(F.col(c)).isNotNull(), order)
    rules = {
        "path": text("path"),
        "smoke_test": Rule(F.col("smoke_test"), F.col("smoke_test").isNotNull(), order),
        "span_start": text("span_start"),
        "timestamp_utc": Rule(F.col("timestamp_utc"), instant(F.col("timestamp_utc")).isNotNull(), order),
        "results": Rule(F.col("results"), _usable_results(), order[1:], large=True),
    }
    return survivors(keyed, ["file", "span_day", "seed"], rules, instant(F.col("timestamp_utc")), F.col("run_id"))
