"""Markdown on the driver from results that are already small: tables, letters and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cell(value: object) -> str:
    if value is None:
        return "–"
    if isinstance(value, float):
        return f"{value:.4g}"
    if isinstance(value, (list, tuple)):
        return ", ".join(cell(v) for v in value)
    return str(value).replace("|", "\\|").replace("\n", " ")


def table(rows: DataFrame, most: int = 500) -> str:
    """A Markdown table of the first ``most`` rows, which says so where there are more."""
    found = rows.limit(most + 1).collect()
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    lines = ["| " + " | ".join(cell(v) for v in r) + " |" for r in found[:most]]
    return "\n".join([head, *lines, *(["", f"First {most} rows."] if len(found) > most else [])]) + "\n"


def statistics(verdicts: DataFrame) -> str:
    """Report of paired tests: exact n and p always, null results kept."""
    ordered = verdicts.orderBy("study", "w_p", "a", "b")
    return "# Paired tests\n\n" + table(ordered.select("study", "a", "b", "n", "mean_diff", "ci_lo", "ci_hi", "w_p", "t_p", "tost_p", "holm_reject", "winner", "verdict"))


def claims(classified: DataFrame) -> str:
    """Counts of buckets, then claims that look like errors first, then by value."""
    counts = classified.groupBy("bucket").agg(F.count(F.lit(1)).alias("claims")).orderBy("bucket")
    shown = classified.withColumn("ctx", F.substring(F.replace("ctx", F.lit("|"), F.lit("/")), 1, 120)) if "ctx" in classified.columns else classified
    return "# Numeric claims\n\n" + table(counts) + "\n" + table(shown.filter("bucket <> 'MATCHED'").orderBy(~F.col("mape_like"), "val"))


def bibliography(audited: DataFrame, order: tuple[str, ...]) -> str:
    """Entries, worst verdict first."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("verdict"))
    return "# Bibliography\n\n" + table(audited.orderBy(place, "entry"))


def response_letter(comments: DataFrame) -> DataFrame:
    """``reviewer, ord, value``: the paragraphs of a letter, one for each comment, headed where a reviewer's begin; open ones are marked.

    Rows, as comments may be many; in order of ``reviewer`` and ``ord`` they are the letter.
    """
    first = F.min("ord").over(Window.partitionBy("reviewer")) == F.col("ord")
    head = F.when(first, F.concat(F.lit("## Reviewer "), "reviewer", F.lit("\n\n"))).otherwise(F.lit(""))
    changed = F.when(F.coalesce(F.size("anchors"), F.lit(0)) > 0, F.concat(F.lit("\n*(changed: "), F.array_join("anchors", ", "), F.lit(")*"))).otherwise(F.lit("")) if "anchors" in comments.columns else F.lit("")
    answer = F.when(F.coalesce("response", F.lit("")) != "", F.concat("response", changed)).otherwise(F.lit("**[RESPONSE PENDING]**"))
    return comments.select("reviewer", "ord", F.concat(head, F.lit("> **"), "id", F.lit(":** "), "text", F.lit("\n\n"), answer, F.lit("\n")).alias("value"))


def notebook(entries: DataFrame, superseded: DataFrame) -> str:
    """Chronology of a log by track; superseded entries name what replaced them."""
    both = entries.join(superseded, "id", "left").orderBy("track", "id")
    return "# Log\n\n" + table(both.select("track", "id", "type", "session", "text", F.col("by").alias("superseded_by")))
