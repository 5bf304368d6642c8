"""Paired statistics over runs that are aligned by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import stats
from attestra.functions.running import running_sum

METRICS = ("mape", "rmse", "mae")
def stem(notebook: Column) -> Column:
    """File name without its last extension, folder kept."""
    return F.regexp_replace(notebook, r"(?<=[^/.])\.[^./]*$", "")


def study_auto(notebook: Column, span: Column) -> Column:
    """``stem`` or ``stem@span``; an empty span counts as none and a null notebook has no study."""
    return F.when(notebook.isNotNull(), F.concat_ws("@", stem(notebook), F.when(span != "", span)))


def load_study_map(spark: SparkSession, path: str | None = None) -> DataFrame | None:
    """``notebook, span, study`` of a JSON object of ``notebook::span`` keys. Without a path there is no map; a path without a file is an error."""
    if path is None:
        return None
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "study"))
    return whole.select(F.regexp_extract("k", r"(?s)^(.*?)::", 1).alias("notebook"), F.regexp_replace("k", r"(?s)^.*?::", "").alias("span"), "study")


def with_study(runs: DataFrame, studies: DataFrame | None = None) -> DataFrame:
    """``runs`` with ``study``: by the map of (notebook, span), or named after the notebook without a map.

    With a map, runs that it doesn't have and those with a null study are left out. The map is joined as
    Spark sees fit; it is small where it is a hand-written file.
    """
    if studies is None:
        return runs.withColumn("study", study_auto(F.col("notebook"), F.col("span_start"))).filter("study is not null")
    named = studies.filter("study is not null").select("notebook", F.coalesce("span", F.lit("")).alias("_span"), "study")
    return runs.withColumn("_span", F.coalesce("span_start", F.lit(""))).join(named, ["notebook", "_span"]).drop("_span")


def _last_first(text: Column) -> Column:
    """A text that sorts the other way round than ``text``, so that the first of several can be a greatest value."""
    return F.concat(F.translate(F.hex(F.encode(text, "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def supersede(runs: DataFrame, keys: tuple[str, ...] = ("study", "seed"), time: str = "timestamp_utc", first: str = "path", seen: str | None = None) -> DataFrame:
    """The newest run of each key: greatest ``time`` as text (null first), on ties the first ``first``.

    Smoke tests are left out before. The newest run replaces the older as a whole. One aggregation, which
    combines before the shuffle, so many reruns of one key meet as one row per partition. ``seen`` names a
    column for the first ``first`` of all runs of the key.
    """
    real = runs.filter(~F.coalesce(F.col("smoke_test"), F.lit(False)))
    others = [c for c in runs.columns if c not in keys]
    rank = F.struct(F.coalesce(time, F.lit("")).alias("time"), _last_first(F.coalesce(first, F.lit(""))).alias("first"))
    firsts = [F.min(F.coalesce(first, F.lit(""))).alias(seen)] if seen else []
    return real.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("_r"), *firsts).select(*keys, "_r.*", *([seen] if seen else []))


def cube(runs: DataFrame) -> DataFrame:
    """``study, seed, config, mape, rmse, mae, params``: configurations with a mape that is a number."""
    exploded = runs.select("study", "seed", F.explode("results").alias("config", "_v"))
    long = exploded.select("study", "seed", "config", *[F.col(f"_v.{m}").alias(m) for m in METRICS], F.col("_v.params").alias("params"))
    return long.filter(F.col("mape").isNotNull() & ~F.isnan("mape"))


def listing(cubed: DataFrame) -> DataFrame:
    """Seeds and configurations of each study, sorted."""
    return cubed.groupBy("study").agg(F.array_sort(F.collect_set("seed")).alias("seeds"), F.array_sort(F.collect_set("config")).alias("configs"))


def config_means(cubed: DataFrame, metric: str = "mape") -> DataFrame:
    """Mean over seeds of each configuration; infinite where there is no value, so that it sorts last."""
    value = F.when(~F.isnan(metric), F.col(metric))
    return cubed.groupBy("study", "config").agg(F.coalesce(F.avg(value), F.lit(float("inf"))).alias("mean"), F.count(value).alias("seeds"))


def pairs_of(cubed: DataFrame, metric: str = "mape", pairs: DataFrame | None = None) -> DataFrame:
    """``study, a, b, seed, d``: differences a - b of each pair of configurations on the same seed.

    ``pairs`` has ``study, a, b``; without it all pairs with a < b. The null seed matches itself. Wanted pairs
    are looked up first, so only their own values meet.
    """
    long = cubed.select("study", "seed", "config", F.col(metric).alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    left, right = long.withColumnsRenamed({"config": "a", "x": "xa"}), long.withColumnsRenamed({"config": "b", "x": "xb"}).alias("r")
    same = (F.col("l.study") == F.col("r.study")) & F.col("l.seed").eqNullSafe(F.col("r.seed"))
    if pairs is None:
        both = left.alias("l").join(right, same & (F.col("a") < F.col("b"))).select("l.study", "l.seed", "a", "b", "xa", "xb")
    else:
        wanted = left.join(pairs.select("study", "a", "b").distinct(), ["study", "a"]).alias("l")
        both = wanted.join(right, same & (F.col("l.b") == F.col("r.b"))).select("l.study", "l.seed", "a", "l.b", "xa", "xb")
    return both.select("study", "a", "b", "seed", "xa", "xb", (F.col("xa") - F.col("xb")).alias("d"))


def signed_ranks(paired: DataFrame, keys: tuple[str, ...] = ("study", "a", "b")) -> DataFrame:
    """Wilcoxon's signed-rank test of each group: ``<keys>, n_nonzero, w_plus, w_p``.

    Zero differences are dropped; ranks are midranks of |d| on the raw doubles. Groups up to
    ``stats.EXACT_TIED`` pairs (``EXACT_UNTIED`` without ties) are tested exactly, larger ones by the normal
    approximation with the tie correction. Groups are counted first: one of up to ``EXACT_UNTIED`` pairs is a list. In larger
    ones ranks come from counts of equal values and running sums over ranges of values, so a group of any size
    spreads over as many tasks as it has ranges.
    """
    ks = list(keys)
    rows = paired.filter("d <> 0").select(*ks, "d")
    counts = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("n_nonzero"))
    few = F.col("n_nonzero") <= stats.EXACT_UNTIED
    lists = rows.join(counts.filter(few), ks).groupBy(*ks, "n_nonzero").agg(F.collect_list("d").alias("_d"))
    small = lists.withColumn("_t", stats.signed_rank_tests("_d")).select(*ks, "n_nonzero", "_t.w_plus", "_t.w_p")

    many = rows.join(counts.filter(~few).select(*ks), ks, "left_semi")
    values = many.withColumn("_m", F.abs("d")).groupBy(*ks, "_m").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("plus"))
    edges = values.groupBy(*ks).agg(F.percentile_approx("_m", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(1000)).alias("_edges"))
    ranged = values.join(edges, ks).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col("_m"))))
    ranked = running_sum(ranged, ks, "_part", ["_m"], "t", "_upto").withColumn("rank", F.col("_upto") - F.col("t") + (F.col("t") + 1) / 2)
    t, n = F.col("t").cast("double"), F.col("n_nonzero").cast("double")
    sums = ranked.groupBy(*ks).agg(F.sum("t").alias("n_nonzero"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(t * t * t - t).alias("ties"))
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    return small.unionByName(sums.select(*ks, "n_nonzero", "w_plus", stats.normal_two_sided(z).alias("w_p")))


def pair_effects(paired: DataFrame) -> DataFrame:
    """Count, means, median and mean difference, sample deviation and standardised effect of each pair."""
    grouped = paired.groupBy("study", "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.avg("xa").alias("mean_a"), F.avg("xb").alias("mean_b"), F.percentile("d", 0.5).alias("median_diff"), F.avg("d").alias("mean_diff"),
        F.stddev_samp("d").alias("sd"), F.max(F.abs("d")).alias("_largest"), F.min("d").alias("_low"), F.max("d").alias("_high"),
    )
    # Equal differences have no spread, whatever rounding leaves of it.
    sd = F.when(F.col("_low") == F.col("_high"), F.lit(0.0)).otherwise(F.col("sd"))
    flat = grouped.withColumn("sd", F.when(F.col("n") > 1, sd)).withColumn("all_zero", F.col("_largest") == 0).drop("_largest", "_low", "_high")
    return flat.withColumn("dz", F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("sd")))


def pair_tests(paired: DataFrame, tost_margin: float | None = None, least: int = 3) -> DataFrame:
    """The full comparison of each pair; pairs with fewer than ``least`` seeds have a note and no tests.

    ``ci_lo, ci_hi``: 95 % interval of the mean difference, collapsed where all differences are equal.
    ``w_p``: signed ranks, ``t_p``: paired t. Where all differences are zero both are 1. ``tost_p`` is the
    greater of the two one-sided p at plus and minus the margin; a margin of zero is none.
    """
    base = pair_effects(paired)
    ranks = signed_ranks(paired).select("study", "a", "b", "w_p")
    enough, df = F.col("n") >= least, (F.col("n") - 1).cast("double")
    se = F.when(F.col("sd") > 0, F.col("sd") / F.sqrt("n"))
    t = F.col("mean_diff") / se
    staged = base.join(ranks, ["study", "a", "b"], "left").withColumns({"_df": F.when(enough, df), "_se": se, "_t": t})
    half = stats.t_critical(F.lit(0.975), F.col("_df")) * F.col("_se")
    out = staged.withColumn("_half", F.when(F.col("sd") == 0, F.lit(0.0)).otherwise(half)).withColumn("_tp", stats.t_two_sided("_t", "_df"))
    columns = {
        "median_diff": F.when(enough, F.col("median_diff")), "mean_diff": F.when(enough, F.col("mean_diff")), "ci_lo": F.when(enough, F.col("mean_diff") - F.col("_half")), "ci_hi": F.when(enough, F.col("mean_diff") + F.col("_half")), "dz": F.when(enough, F.col("dz")),
        "w_p": F.when(enough, F.when(F.col("all_zero"), 1.0).otherwise(F.col("w_p"))), "t_p": F.when(enough, F.when(F.col("all_zero"), 1.0).when(F.col("sd") == 0, 0.0).otherwise(F.col("_tp"))),
        "note": F.when(~enough, F.concat(F.lit("only "), F.col("n"), F.lit(" shared seed(s) -- too few to test"))).when(F.col("all_zero"), "identical on every seed"),
    }
    if tost_margin:
        below = stats.t_above((F.col("mean_diff") + tost_margin) / F.col("_se"), F.col("_df"))
        above = stats.t_above((tost_margin - F.col("mean_diff")) / F.col("_se"), F.col("_df"))
        flat = F.when(F.abs("mean_diff") < tost_margin, 0.0).otherwise(1.0)
        out = out.withColumn("_flat", flat).withColumn("_tost", F.when(F.col("sd") > 0, F.greatest(below, above)))
        columns["tost_p"] = F.when(enough, F.when(F.col("sd") == 0, F.col("_flat")).otherwise(F.col("_tost")))
    else:
        columns["tost_p"] = F.lit(None).cast("double")
    columns["tost_margin"] = F.lit(tost_margin or None).cast("double")
    return out.withColumns(columns).drop("_df", "_se", "_t", "_half", "_tp", "_flat", "_tost")


def holm(tested: DataFrame, alpha: float = 0.05, family: str = "study", p: str = "w_p", order: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Step-down correction in each family: ``holm_threshold`` and ``holm_reject``; null p take no part.

    Once a hypothesis is kept, all with greater p are. A family has as many rows as it has tests.
    """
    ranked = Window.partitionBy(family, F.col(p).isNull()).orderBy(p, *order)
    size = F.count(p).over(Window.partitionBy(family))
    out = tested.withColumn("_rank", F.row_number().over(ranked)).withColumn("holm_threshold", F.when(F.col(p).isNotNull(), alpha / (size - F.col("_rank") + 1)))
    passed = F.min((F.col(p) <= F.col("holm_threshold")).cast("int")).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("holm_reject", F.when(F.col(p).isNotNull(), passed == 1)).drop("_rank")


def default_battery(cubed: DataFrame, baselines: list[str], metric: str = "mape") -> DataFrame:
    """Pairs worth testing: best against runner-up, then the best other one against each baseline there."""
    means = config_means(cubed, metric)
    by_mean = Window.partitionBy("study").orderBy("mean", "config")
    placed = means.withColumn("place", F.row_number().over(by_mean))
    is_base = F.col("config").isin(baselines) if baselines else F.lit(False)
    best = placed.filter("place = 1").select("study", F.col("config").alias("a"))
    second = placed.filter("place = 2").select("study", F.col("config").alias("b"))
    own = placed.filter(~is_base).groupBy("study").agg(F.min_by("config", "place").alias("a"))
    ranked_base = F.array_position(F.array(*[F.lit(b) for b in baselines]), F.col("config")) if baselines else F.lit(1)
    bases = placed.filter(is_base).select("study", F.col("config").alias("b"), (ranked_base + 1).cast("int").alias("ord"))
    pairs = best.join(second, "study").withColumn("ord", F.lit(1)).unionByName(own.join(bases, "study"))
    return pairs.groupBy("study", "a", "b").agg(F.min("ord").alias("ord"))


def verdicts(tested: DataFrame, alpha: float = 0.05, use_holm: bool = True) -> DataFrame:
    """``winner`` (the one with the lower mean) and ``verdict``: significant, equivalent, inconclusive, not significant, too few."""
    winner = F.when(F.col("mean_diff") < 0, F.col("a")).when(F.col("mean_diff").isNotNull(), F.col("b"))
    significant = F.col("holm_reject") if use_holm else F.col("w_p") <= alpha
    verdict = (
        F.when(F.col("w_p").isNull(), "too few seeds").when(significant, "significant")
        .when(F.col("tost_p") <= alpha, "equivalent").when(F.col("tost_margin").isNotNull(), "inconclusive").otherwise("not significant")
    )
    return tested.withColumn("winner", winner).withColumn("verdict", verdict)


def format_p(p: Column) -> Column:
    """Four decimals from 1e-4 on, else two digits with exponent, of the exact binary value; ``n/a`` for null."""
    return F.coalesce(stats.format_numbers(F.when(p >= 1e-4, F.lit(".4f")).otherwise(F.lit(".1e")), p), F.lit("  n/a "))
