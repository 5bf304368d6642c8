"""Sweeps of runs: expansion, resumption, journal rows, summaries and injected parameters."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def run_id(prefix: Column, number: Column) -> Column:
    return F.format_string("%s-run%03d", prefix, number.cast("int"))


def expand(sweeps: DataFrame) -> DataFrame:
    """``sweep, idx, run_id, params``: one row for each parameter map of ``sweep, prefix, runs``; numbers from 1."""
    flat = sweeps.select("sweep", "prefix", F.posexplode("runs").alias("idx", "params"))
    return flat.select("sweep", "idx", run_id(F.col("prefix"), F.col("idx") + 1).alias("run_id"), "params")


def completed(journal: DataFrame, exact: bool = True) -> DataFrame:
    """``run_id`` of finished runs; by the status itself, or wherever the row says ``complete`` (also in ``incomplete``)."""
    done = F.col("status") == "complete" if exact else F.contains(F.concat_ws("|", *[F.col(c).cast("string") for c in journal.columns]), F.lit("complete"))
    return journal.filter(done).select("run_id").distinct()


def pending(runs: DataFrame, journal: DataFrame, most: int | None = None, exact: bool = True) -> DataFrame:
    """Runs that the journal hasn't finished; ``most`` limits how many are started next."""
    left = runs.join(completed(journal, exact), "run_id", "left_anti")
    return left if most is None else left.orderBy("run_id").limit(most)


def journal_line(row: DataFrame) -> DataFrame:
    """Rows of a Markdown table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("run_id", "account", "params", "status", "summary", "runtime_s", "timestamp")]
    return row.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def parse_journal(lines: DataFrame) -> DataFrame:
    """``run_id, account, params, status, summary, runtime_s, timestamp`` of Markdown table rows with a run id."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select(cells.alias("c")).filter((F.size("c") >= 7) & F.get("c", F.lit(0)).rlike(r"-run\d{3}$"))
    names = ("run_id", "account", "params", "status", "summary")
    return rows.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)], F.get("c", F.lit(5)).try_cast("double").alias("runtime_s"), F.get("c", F.lit(6)).alias("timestamp"))


def _joined(labels: pd.Series, values: pd.Series, form) -> list[list[str] | None]:
    return [None if ks is None else [x for k, v in zip(ks, vs) if (x := form(k, v)) is not None] for ks, vs in zip(labels, values)]


def _percent(labels: pd.Series, values: pd.Series) -> pd.Series:
    found = _joined(labels, values, lambda k, v: None if v is None else f"{k}={float(v):.2f}%")
    return pd.Series([", ".join(parts) if parts else "-" for parts in found], dtype=object)


def summarize_mape(results: Column) -> Column:
    """``config=x.xx%`` of the configurations with a mape, in order; ``-`` where there is none; digits of the exact binary value.

    NaN is a mape like others, as it can be written.
    """
    return F.pandas_udf(_percent, "string")(F.map_keys(results), _stored(F.map_values(results)))


def _stored(values: Column) -> Column:
    """Each mape as a text, which tells NaN from null on the way to Python."""
    return F.transform(values, lambda v: v["mape"].cast("string"))


#: Configurations that a summary shows.
SHOWN = 6


def _results(labels: pd.Series, values: pd.Series, smoke: pd.Series) -> pd.Series:
    found = _joined(labels, values, lambda k, v: f"{k}=?" if v is None else f"{k}={float(v):.3f}")
    rows = []
    for parts, test in zip(found, smoke):
        more = f" (+{len(parts) - SHOWN} more)" if parts and len(parts) > SHOWN else ""
        rows.append("mape: " + ", ".join(parts[:SHOWN]) + more + (" [SMOKE]" if test is True or test == 1 else "") if parts else "no results key!")
    return pd.Series(rows, dtype=object)


def summarize_results(results: Column, smoke: Column) -> Column:
    """``mape: config=x.xxx`` of the first configurations, ``?`` for null, how many more there are, and a mark for smoke tests."""
    return F.pandas_udf(_results, "string")(F.map_keys(results), _stored(F.map_values(results)), F.coalesce(smoke, F.lit(False)))


def literal_text(value: Column | str) -> Column:
    """A value as the literal that it reads as, else as a quoted text."""
    return F.pandas_udf(_literals, "string")(value)


def _literals(value: pd.Series) -> pd.Series:

    def one(v: str | None) -> str | None:
        if v is None:
            return None
        try:
            return repr(ast.literal_eval(v))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return repr(v)

    return pd.Series([one(v) for v in value], dtype=object)


CELL = "struct<cell_type:string,metadata:struct<tags:array<string>>,source:array<string>>"


def inject(cells: Column, source: Column) -> Column:
    """Notebook cells with one more, tagged ``injected-parameters``, after the first tagged ``parameters``; null without one."""
    tagged = F.transform(cells, lambda c: F.coalesce(F.array_contains(c["metadata"]["tags"], "parameters"), F.lit(False)))
    at = F.array_position(tagged, F.lit(True)).cast("int")
    new = F.struct(F.lit("code").alias("cell_type"), F.struct(F.array(F.lit("injected-parameters")).alias("tags")).alias("metadata"), source.alias("source")).cast(CELL)
    return F.when(at > 0, F.concat(F.slice(cells, F.lit(1), at), F.array(new), F.slice(cells, at + 1, F.greatest(F.size(cells) - at, F.lit(0)))))


def run_status(polled: Column, dry: Column) -> Column:
    """Journal status of a run: ``dry_run``, ``complete``, or ``FAILED (<polled status>)``."""
    return F.when(F.coalesce(dry, F.lit(False)), "dry_run").when(polled == "complete", "complete").otherwise(F.concat(F.lit("FAILED ("), F.coalesce(polled, F.lit("unknown")), F.lit(")")))


def append_journal(rows: DataFrame, folder: str) -> None:
    """Appends rows as lines of a Markdown table, one file each time, so no lock is needed."""
    journal_line(rows).write.mode("append").text(folder)


def finished(landed: DataFrame) -> DataFrame:
    """Journal rows of landed results (``run_id, results, smoke_test, landed_at``): complete, with their summary."""
    return landed.select(
        "run_id", F.lit("colab").alias("account"), F.lit("(see injected cell)").alias("params"), F.lit("complete").alias("status"), summarize_results(F.col("results"), F.col("smoke_test")).alias("summary"), F.lit(None).cast("double").alias("runtime_s"),
        F.date_format("landed_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
    )


def load_sweep(spark: SparkSession, path: str) -> DataFrame:
    """``sweep, prefix, runs`` of a YAML file (``kernel_slug_prefix`` and ``runs``, a list of parameter maps); values as written.

    One small file, read where the plan is made. Needs a YAML reader, which is an error where there is none.
    """
    import yaml

    whole = spark.read.text(path, wholetext=True).first().value
    found = yaml.safe_load(whole) or {}
    runs = [{str(k): str(v) for k, v in (r or {}).items()} for r in found.get("runs") or []]
    return spark.createDataFrame([(path, found["kernel_slug_prefix"], runs)], "sweep string, prefix string, runs array<map<string,string>>")


def accounts(spark: SparkSession, path: str) -> DataFrame:
    """``name, username`` of the accounts of a YAML file; where secrets lie is left to the caller. No file is no account."""
    import yaml

    try:
        whole = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        whole = None
    rows = [(a["name"], a.get("kaggle_username")) for a in ((yaml.safe_load(whole.value) or {}) if whole else {}).get("accounts", [])]
    return spark.createDataFrame(rows, "name string, username string").dropDuplicates(["name"])
