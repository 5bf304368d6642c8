"""Mixing sources to target weights by weighted fair queueing.

Every document (and every allowed repeat of it) gets a virtual finish time: the tokens of its source
so far, in shuffled order, divided by the source's share. In order of finish times all sources
progress in proportion to their shares; the mixture is the longest beginning of that order within
the budget.

Both running sums are taken in two steps, so neither a source that holds a third of all rows nor the
global order is ever a single task: sums of small ranges first, running totals over these, and exact
sums inside each range after. The mixture is range-sorted by its running total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.running import running_sum
from attestra.session import cut_lineage

#: Rows that a range aims to hold.
RANGE_ROWS = 50_000


def plan(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """One row per target source: share, tokens there are and may be used, and the total budget.

    ``share`` is the weight over the weights of the sources that have tokens; the others have share 0.
    Without a budget it is the largest total at which every such source can reach its share within
    its cap on repeats, so no share has to give way. Weights that are null, zero or negative and caps
    below one leave a source out. Several rows of a source in ``targets`` count as one with the
    greatest weight.
    """
    wanted = targets.filter(F.col("source").isNotNull() & (F.col("target_weight") > 0) & (F.col("max_repeats") >= 1)).groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max_by("max_repeats", "target_weight").cast("int").alias("max_repeats"))
    stock = sized.filter((F.col("tokens") > 0) & F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    both = wanted.join(stock, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    everywhere = Window.partitionBy()  # as many rows as targets
    live = F.when(F.col("tokens") > 0, F.col("target_weight"))
    both = both.withColumn("share", F.coalesce(live / F.sum(live).over(everywhere), F.lit(0.0)))
    reach = F.min(F.when(F.col("share") > 0, F.col("tokens") * F.col("max_repeats") / F.col("share"))).over(everywhere)
    return both.withColumn("budget", F.lit(budget).cast("bigint") if budget is not None else F.floor(reach).cast("bigint"))


def mix(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mixture: ``doc_id, source, copy, tokens, finish, mixed_tokens`` in order of ``finish``.

    ``sized`` has ``doc_id, source, tokens``. ``copy`` counts the uses of a document from 0, below the
    cap of its source; no document is used again before all of its source were used equally often.
    ``mixed_tokens`` is the running total, at most the budget. A source whose documents run out under
    a larger budget stops there and the others go on. Rows without tokens, with a null source or one
    that is no target are not chosen. Rows stored twice are two documents. Ties of the shuffle and of
    finish times go by ``doc_id``, source and copy. How often a source is gone through follows from its tokens
    and its part of the budget, so no more than one pass of each is made for nothing, whatever the caps.
    """
    plans = cut_lineage(plan(sized, targets, budget))
    # A pass begins in time if what the passes before it take is at most the source's part of the budget.
    passes = F.least(F.col("max_repeats").cast("bigint"), F.floor(F.col("budget") * F.col("share") / F.col("tokens")) + 1)
    # As many rows as there are targets, so the size is bounded by that table.
    known = F.broadcast(plans.filter("share > 0").select("source", "share", passes.alias("passes"), "documents", "budget"))
    usable = sized.select("doc_id", "source", F.col("tokens").cast("bigint").alias("tokens")).filter((F.col("tokens") > 0) & F.col("source").isNotNull())
    copies = usable.join(known, "source").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("passes") - 1).cast("int"))))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "copy", "source", "doc_id"), F.lit(1 << 40)).alias("draw")
    copies = copies.select("*", drawn)
    ranges = F.ceil(F.col("documents") / range_rows)
    part = (F.col("copy") * ranges + F.floor(F.col("draw") * ranges / (1 << 40))).cast("bigint")
    queued = running_sum(copies.withColumn("_part", part), ["source"], "_part", ["copy", "draw", "doc_id", "tokens"], "tokens", "_source_tokens")
    finished = queued.withColumn("finish", F.col("_source_tokens") / F.col("share")).filter(F.col("finish") - F.col("tokens") / F.col("share") <= F.col("budget"))
    # Equal stretches of virtual time hold about equally many tokens.
    total = F.broadcast(plans.filter("share > 0").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("documents") * passes) / range_rows)).alias("_bins"), F.max("budget").alias("_budget")))
    binned = finished.crossJoin(total).withColumn("_bin", F.floor(F.col("finish") / (F.col("_budget") + 1) * F.col("_bins")).cast("bigint"))
    order = ["finish", "source", "copy", "draw", "doc_id"]
    ordered = running_sum(binned.withColumn("_all", F.lit(0)), ["_all"], "_bin", order, "tokens", "mixed_tokens")
    return ordered.filter(F.col("mixed_tokens") <= F.col("budget")).select("doc_id", "source", "copy", "tokens", "finish", "mixed_tokens").orderBy("mixed_tokens")


def shares(mixture: DataFrame, sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """``source, target_share, reached_share, mixed, documents, uses, most_uses, budget`` of every target source."""
    used = mixture.groupBy("source").agg(F.sum("tokens").alias("mixed"), F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("uses"), (F.max("copy") + 1).alias("most_uses"))
    planned = plan(sized, targets, budget).select("source", F.col("share").alias("target_share"), "budget")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = planned.join(used, "source", "left").select("source", "target_share", zero("mixed"), zero("documents"), zero("uses"), zero("most_uses"), "budget")
    return joined.withColumn("reached_share", F.coalesce(F.try_divide("mixed", F.sum("mixed").over(Window.partitionBy())), F.lit(0.0)))
