"""Numeric claims of texts against a pool of true values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from attestra.functions import stats, text

#: The most pool values that are sent to every task; larger pools are joined by ranges.
BROADCAST_POOL = 100_000


def scrub(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``documents`` with ``clean``: the body without what can't be a claim."""
    markdown = text.is_markdown(F.col(path)) if path else F.lit(True)
    return documents.withColumn("clean", text.scrubbed(text.body(F.col("text"), markdown), markdown))


def extract(documents: DataFrame, key: str = "doc_id", column: str = "clean") -> DataFrame:
    """``<key>, pos, tok, val``: every numeric claim in order. Null and empty texts have none."""
    found = documents.select(key, F.posexplode(text.numbers(F.col(column))).alias("pos", "tok"))
    return found.withColumn("val", text.as_number(F.col("tok")))


def contexts(documents: DataFrame, key: str = "doc_id", key_type: str = "bigint", column: str = "clean", reach: int = 55) -> DataFrame:
    """``<key>, pos, tok, ctx``: claims with the text around them, white space collapsed."""
    pattern = regex.compile(text.NUMBER)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, body in zip(batch[key], batch[column]):
                for i, m in enumerate(pattern.finditer(body or "")):
                    rows.append((k, i, m.group(1), " ".join(body[max(0, m.start() - reach) : m.end() + reach].split())))
            yield pd.DataFrame(rows, columns=[key, "pos", "tok", "ctx"])

    return documents.select(key, column).mapInPandas(cut, f"{key} {key_type}, pos int, tok string, ctx string")


def pool_from_tables(tables: DataFrame, path: str = "path") -> DataFrame:
    """``value, src, ord``: every number of table fragments (``path``, ``text``), named after their file.

    ``ord`` follows the paths and the places inside; ``{,}`` counts as a comma. Null texts have no number.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    found = tables.select(F.col(path).alias("_path"), name.alias("src"), F.posexplode(text.numbers(F.replace(text.unix_lines(F.col("text")), F.lit("{,}"), F.lit(",")))).alias("_at", "_tok"))
    return found.select(text.as_number(F.col("_tok")).alias("value"), "src", F.struct(F.lit(0).alias("origin"), F.col("_path").alias("path"), F.col("_at").alias("place"), F.lit(0).alias("at")).alias("ord"))


def result_measures(runs: DataFrame) -> DataFrame:
    """``src, metric, mean, sd, n, first, met`` of every study, configuration and metric of superseded runs."""
    flat = runs.select("study", "seed", F.coalesce("first_path", F.lit("")).alias("_path"), F.posexplode("results").alias("_place", "config", "_v"))
    measured = F.array(*[F.struct(F.lit(i).alias("_at"), F.lit(m).alias("metric"), F.col(f"_v.{m}").cast("double").alias("x")) for i, m in enumerate(("mape", "rmse", "mae", "params"))])
    long = flat.select("study", "seed", "_path", "_place", "config", F.inline(measured)).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    met = F.struct(F.col("_path").alias("path"), (F.col("_place") * 4 + F.col("_at")).alias("place"), "seed")
    grouped = long.groupBy("study", "config", "metric").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count(F.lit(1)).alias("n"), F.min_by("x", met).alias("first"), F.min(met).alias("met"))
    return grouped.select(F.concat_ws(":", "study", "config", "metric").alias("src"), "metric", "mean", "sd", "n", "first", "met")


def pool_from_results(runs: DataFrame) -> DataFrame:
    """``value, src, ord``: rounded means and deviations of every study, configuration and metric, and the first parameter count.

    ``runs`` are superseded runs: ``study, seed, first_path, results`` (``study.supersede(..., seen="first_path")``). A
    metric counts wherever it is a number, also where another one of the configuration is not. Rounding is that of
    the exact binary value, half to even. Deviations need two values or more. ``src`` is
    ``study:configuration:metric``; first is by ``first_path``, then the place of the configuration.
    """
    entry = lambda at, value: F.struct(F.lit(at).alias("_at"), value.alias("value"))
    rounded = F.array(
        entry(0, stats.half_even("mean", F.lit(2))), entry(1, stats.half_even("mean", F.lit(1))), entry(2, stats.half_even(F.when(F.col("n") > 1, F.col("sd")), F.lit(2))),
        entry(3, F.when(F.col("metric") == "params", F.col("first"))),
    )
    rows = result_measures(runs).select("src", "met", F.inline(rounded)).filter("value is not null")
    return rows.select("value", "src", F.struct(F.lit(1).alias("origin"), F.col("met.path").alias("path"), F.col("met.place").alias("place"), F.col("_at").alias("at")).alias("ord"))


def union_pools(*pools: DataFrame) -> DataFrame:
    """One pool of several ``value, src, ord`` ones; tables come before results."""
    whole, *more = pools
    for pool in more:
        whole = whole.unionByName(pool)
    return whole


def ordered_pool(pool: DataFrame) -> DataFrame:
    """``value, src, ord``: the pool without repeated values; the first entry stands for each.

    First is by ``ord`` where the pool has it, else by the name of the source.
    """
    known = pool.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    order = F.col("ord") if "ord" in pool.columns else F.col("src")
    return known.groupBy("value").agg(F.min_by("src", F.struct(order, "src")).alias("src"), F.min(order).alias("ord"))


def bucket(claim: Column, truth: Column) -> Column:
    """MATCHED, NEAR-MISS or ORPHAN of a claim and its nearest truth; ORPHAN without one."""
    gap = F.abs(claim - truth)
    share = gap / F.greatest(claim, F.lit(1.0))
    small = F.when(gap <= 0.005, "MATCHED").when(gap <= 0.10, "NEAR-MISS")
    large = F.when((gap < 0.5) | (share < 0.003), "MATCHED").when(share < 0.05, "NEAR-MISS")
    return F.coalesce(F.when(claim < 100, small).otherwise(large), F.lit("ORPHAN"))


def nearest(claims: DataFrame, pool: DataFrame, value: str = "val") -> DataFrame:
    """``claims`` with ``best`` and ``src`` of the nearest pool value; on ties the first entry, then the lower value.

    A claim that is null or NaN, and every claim where the pool is empty, has null in both.
    A pool of up to ``BROADCAST_POOL`` values is a sorted array in every task, searched by halving.
    A larger one is merged with the claims in order of value: ranges of values are sorted on their own
    and the neighbours before and after each range come from the ends of the other ranges.
    """
    own = ordered_pool(pool)
    few = own.limit(BROADCAST_POOL + 1).collect()
    if len(few) <= BROADCAST_POOL:
        return _nearest_in_array(claims, few, value)
    return _nearest_by_ranges(claims, own, value)


def _nearest_in_array(claims: DataFrame, pool: list[Row], value: str) -> DataFrame:
    place = {r.value: i for i, r in enumerate(sorted(pool, key=lambda r: (r.ord, r.src)))}
    by_value = sorted(pool, key=lambda r: r.value)
    shared = claims.sparkSession.sparkContext.broadcast(([r.value for r in by_value], [r.src for r in by_value], [place[r.value] for r in by_value]))

    def search(values: pd.Series) -> pd.DataFrame:
        import numpy as np

        known, names, order = np.array(shared.value[0]), shared.value[1], np.array(shared.value[2])
        if not len(known):
            return pd.DataFrame({"best": [None] * len(values), "src": [None] * len(values)})
        v = values.to_numpy(dtype=float)
        at = np.clip(np.searchsorted(known, v), 1, max(1, len(known) - 1)) if len(known) > 1 else np.zeros(len(v), dtype=int)
        low = np.maximum(at - 1, 0)
        below, above = np.abs(v - known[low]), np.abs(v - known[at])
        pick = np.where((below < above) | (below == above) & (order[low] <= order[at]), low, at)
        return pd.DataFrame({"best": pd.Series([None if x != x else known[i] for x, i in zip(v, pick)], dtype=object), "src": [None if x != x else names[i] for x, i in zip(v, pick)]})

    find = F.pandas_udf(search, "best double, src string")
    return claims.withColumn("_n", find(F.col(value))).select(*claims.columns, "_n.best", "_n.src")


#: Values that a range aims to hold, and bounds of the number of ranges.
RANGE_VALUES, RANGES = 50_000, (16, 4096)


def _nearest_by_ranges(claims: DataFrame, pool: DataFrame, value: str) -> DataFrame:
    """Distinct claimed values are merged with the pool; the claims get their neighbour by a join on the value.

    So a value that many claims have is one row of its range, and the skew of the join is left to AQE.
    """
    asked = claims.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).distinct()
    entry = F.struct(F.col("value").cast("double").alias("v"), F.col("src").alias("s"), F.col("ord").alias("o"))
    known = pool.select(F.col("value").cast("double").alias("_v"), entry.alias("_t"))
    rows = claims.count() + pool.count()
    ranges = min(max(-(-rows // RANGE_VALUES), RANGES[0]), RANGES[1])
    both = asked.unionByName(known.select("_v"))
    edges = F.broadcast(both.agg(F.percentile_approx("_v", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10 * ranges + 1000)).alias("_edges")))

    def placed(values: DataFrame) -> DataFrame:
        """``_part``: how many edges lie below the value, by halving; beyond the last edge there is none below."""
        found = values.crossJoin(edges).withColumn("_part", F.lit(0))
        for step in (1 << i for i in reversed(range(ranges.bit_length()))):
            found = found.withColumn("_part", F.col("_part") + F.when(F.get("_edges", F.col("_part") + (step - 1)) < F.col("_v"), step).otherwise(0))
        return found.drop("_edges")

    own = placed(known)
    ends = own.groupBy("_part").agg(F.min_by("_t", "_v").alias("_first"), F.max_by("_t", "_v").alias("_last"))
    over = Window.partitionBy(F.lit(0)).orderBy("_part")  # one row for each range
    outer = F.broadcast(ends.sparkSession.range(ranges + 1).select(F.col("id").cast("int").alias("_part")).join(ends, "_part", "left").select(
        "_part", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), "_first", F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_above"),
    ))
    # the value after each pool value is looked up among those alone: a frame that ends at the last row is read anew for every row
    pairs = own.withColumn("_next", F.lead("_t").over(Window.partitionBy("_part").orderBy("_v")))
    merged = placed(asked).withColumns({c: F.lit(None).cast(known.schema["_t"].dataType) for c in ("_t", "_next")}).unionByName(pairs)
    inside = Window.partitionBy("_part").orderBy("_v", F.col("_t").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    pair = F.last(F.when(F.col("_t").isNotNull(), F.struct("_t", "_next")), ignorenulls=True).over(inside)
    seen = merged.withColumn("_low", pair).filter("_t is null").drop("_t", "_next").join(outer, "_part", "left")
    low = F.col("_low._t")
    below = F.coalesce(low, F.col("_below"))
    above = F.when(low["v"] == F.col("_v"), low).when(low.isNotNull(), F.coalesce(F.col("_low._next"), F.col("_above"))).otherwise(F.coalesce("_first", "_above"))
    down, up = F.abs(F.col("_v") - below["v"]), F.abs(F.col("_v") - above["v"])
    near = F.when(above.isNull() | (down < up) | ((down == up) & (below["o"] <= above["o"])), below).otherwise(above)
    found = seen.select("_v", F.coalesce(near, above).alias("_n"))
    return claims.join(found, claims[value].cast("double") == found["_v"], "left").select(*claims.columns, F.col("_n.v").alias("best"), F.col("_n.s").alias("src"))


def classify(claims: DataFrame, pool: DataFrame) -> DataFrame:
    """``claims`` with ``best``, ``src``, ``bucket`` and ``mape_like`` (0.3 to 15)."""
    return nearest(claims, pool).withColumn("bucket", bucket(F.col("val"), F.col("best"))).withColumn("mape_like", F.col("val").between(0.3, 15.0))


def buckets(classified: DataFrame) -> DataFrame:
    return classified.groupBy("bucket").agg(F.count(F.lit(1)).alias("claims"))


def figure_staleness(figures: DataFrame, files: DataFrame, newest: Column) -> DataFrame:
    """``figure, state``: N/A with a ``.tex`` twin, MISSING, STALE if older than ``newest``, else fresh.

    ``files`` has ``path`` and ``modified`` of every figure file.
    """
    base = F.regexp_replace("figure", r"(?i)\.(?:pdf|png)$", "")
    pdf = files.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("_pdf"), "modified").filter(F.col("path").endswith(".pdf"))
    tex = files.filter(F.col("path").endswith(".tex")).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("_tex")).distinct()
    seen = figures.select("figure", base.alias("_base")).join(tex, F.col("_base") == F.col("_tex"), "left").join(pdf, F.col("_base") == F.col("_pdf"), "left")
    state = F.when(F.col("_tex").isNotNull(), "N/A").when(F.col("modified").isNull(), "MISSING").when(F.col("modified") < newest, "STALE").otherwise("fresh")
    return seen.select("figure", state.alias("state"))
