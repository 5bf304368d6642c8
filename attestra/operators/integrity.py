"""Checks of single runs and of the coverage of studies by seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_bad(value: Column) -> Column:
    """Null, NaN or infinite."""
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def findings(runs: DataFrame, expect: list[str], anchors: dict[str, int]) -> DataFrame:
    """One row per run: missing configurations, bad metrics, futility stops, anchor mismatches, flags.

    ``fail``: something is missing or bad or off its anchor; ``warn``: a smoke test or a futility stop;
    ``tag``: FAIL, DISCLOSE or OK. Runs without results miss everything that is expected. With a column
    ``parse_error`` a file that couldn't be read has no findings but fails as UNREADABLE. Expressions
    over the run's own map only, so nothing is shuffled.
    """
    entries = F.map_entries(F.coalesce("results", F.expr("map()").cast(runs.schema["results"].dataType)))
    present = F.transform(entries, lambda e: e["key"])
    missing = F.array_except(F.array(*[F.lit(c) for c in expect]).cast("array<string>"), present)
    bad = F.flatten(F.transform(entries, lambda e: F.array_compact(F.array(*[F.when(is_bad(e["value"][m]), F.concat(e["key"], F.lit("."), F.lit(m))) for m in ("mape", "rmse", "mae")]))))
    futile = F.transform(F.filter(entries, lambda e: F.coalesce(e["value"]["futility_stop"], F.lit("")) != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"]["futility_stop"]))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).cast("bigint").alias("v")) for k, v in sorted(anchors.items())]) if anchors else F.expr("array()").cast("array<struct<k:string,v:bigint>>")
    off = F.transform(F.filter(pairs, lambda a: F.exists(entries, lambda e: (e["key"] == a["k"]) & ~e["value"]["params"].eqNullSafe(a["v"]))), lambda a: a["k"])
    out = runs.select("run_id", "notebook", "span_start", "seed", "smoke_test", missing.alias("missing"), bad.alias("bad"), futile.alias("futility"), off.alias("off_anchor"), *([F.coalesce("parse_error", F.lit(False)).alias("_lost")] if "parse_error" in runs.columns else []))
    fail = (F.size("missing") > 0) | (F.size("bad") > 0) | (F.size("off_anchor") > 0)
    warn = F.coalesce(F.col("smoke_test"), F.lit(False)) | (F.size("futility") > 0)
    tagged = out.withColumn("fail", fail).withColumn("warn", warn).withColumn("tag", F.when(F.col("fail"), "FAIL").when(F.col("warn"), "DISCLOSE").otherwise("OK"))
    if "parse_error" not in runs.columns:
        return tagged
    lost = F.col("_lost")
    none = {c: F.when(~lost, F.col(c)) for c in ("missing", "bad", "futility", "off_anchor")}
    return tagged.withColumns(none | {"fail": lost | F.col("fail"), "warn": ~lost & F.col("warn"), "tag": F.when(lost, "UNREADABLE").otherwise(F.col("tag"))}).drop("_lost")


def parse_anchors(spec: str) -> dict[str, int]:
    """``A=1,B=2`` as a map; a malformed part is an error."""
    out = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, sign, number = part.rpartition("=")
        if not sign or not name.strip() or not number.strip().lstrip("-").isdigit():
            raise ValueError(f"anchor {part!r} is not NAME=NUMBER")
        out[name.strip()] = int(number)
    return out


def _study_key() -> Column:
    blank = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    return F.concat(blank("notebook", "?"), F.lit("::"), blank("span_start", ""))


def seed_census(runs: DataFrame) -> DataFrame:
    """``study, seeds, n, runs, robust``: distinct seeds of full runs of each ``notebook::span``, sorted.

    A null notebook is ``?``, a null span is empty. A study that has smoke tests alone is there with none. Null seeds
    don't count. One seed or none is not ``robust``. Distinct pairs come first, so a study's list is built from its seeds.
    """
    full = F.when(~F.coalesce(F.col("smoke_test"), F.lit(False)), F.col("seed"))
    pairs = runs.groupBy(_study_key().alias("study"), full.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    out = pairs.groupBy("study").agg(F.array_sort(F.collect_list("_s")).alias("seeds"), F.sum("_n").alias("runs"))
    return out.select("study", "seeds", F.size("seeds").alias("n"), "runs", (F.size("seeds") > 1).alias("robust"))


def config_seeds(runs: DataFrame) -> DataFrame:
    """``study, config, seeds``: distinct seeds of full runs of each configuration; a null seed is one here."""
    full = runs.filter(~F.coalesce(F.col("smoke_test"), F.lit(False)))
    return full.select(_study_key().alias("study"), "seed", F.explode(F.map_keys("results")).alias("config")).distinct().groupBy("study", "config").agg(F.count(F.lit(1)).alias("seeds"))


def under_coverage(runs: DataFrame, expect: list[str]) -> DataFrame:
    """``study, config, seeds, study_seeds`` of expected configurations with fewer seeds than their study.

    The study's count leaves a null seed out, that of a configuration takes it for one.
    """
    full = runs.filter(~F.coalesce(F.col("smoke_test"), F.lit(False)))
    flat = full.select(_study_key().alias("study"), "seed", F.coalesce(F.map_keys("results"), F.array().cast("array<string>")).alias("_keys"))
    has = []
    for i, c in enumerate(expect):
        held = F.array_contains("_keys", c)
        has.append((F.count_distinct(F.when(held, F.col("seed"))) + F.max(F.when(held & F.col("seed").isNull(), 1).otherwise(0))).alias(f"_{i}"))
    counted = flat.groupBy("study").agg(F.count_distinct("seed").alias("study_seeds"), *has)
    rows = F.array(*[F.struct(F.lit(c).alias("config"), F.col(f"_{i}").alias("seeds")) for i, c in enumerate(expect)])
    return counted.select("study", "study_seeds", F.inline(rows)).filter("seeds < study_seeds").select("study", "config", "seeds", "study_seeds")


def any_failure(found: DataFrame) -> bool:
    return not found.filter("fail").isEmpty()
