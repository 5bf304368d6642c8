"""Survivorship field by field: awkward rows, brute force over stored rows, SQL."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from attestra.functions.forms import instant
from attestra.llm import survivorship
from attestra.llm.queries import LLM

RECORD = "struct<rmse:double,mae:double,mape:double,params:bigint,futility_stop:string,folds:array<struct<fold:int,mape:double,stops:array<struct<epoch:int,reason:string>>>>>"
RESULTS = f"run_id bigint, path string, notebook string, seed bigint, smoke_test boolean, span_start string, timestamp_utc string, results map<string,{RECORD}>"


def config(mape=1.0, folds=None):
    return (1.0, 1.0, mape, 10, None, folds)


def run(run_id, results, notebook="a.ipynb", seed=1, smoke=False, span=None, time="2024-01-01T00:00:00Z", path="p"):
    return (run_id, path, notebook, seed, smoke, span, time, results)


def test_survivors(spark):
    good, bad = {"a": config(1.0)}, {"a": config(float("nan")), "b": None}
    rows = [
        run(10, bad, time="2025-01-01T00:00:00Z"), run(11, good, smoke=True, time="2024-05-01T00:00:00Z"), run(12, good, smoke=None, time="2024-01-01T00:00:00Z"), run(13, good, notebook=" sub/a.ipynb", smoke=None, time="2024-01-01 00:00:00", span="None"),
        run(20, good, notebook="b.ipynb", span="2018-01"), run(21, None, notebook="b", span="2018/01/01", time="unset"), run(22, good, notebook="b", span="2018-02-01"),
        run(30, good, notebook=None), run(31, good, notebook=None), run(40, good, notebook="c", seed=None), run(41, good, notebook="c", seed=None),
    ]
    table = spark.createDataFrame(rows, RESULTS)
    assert {tuple(r) for r in survivorship.surviving_rows(table).collect()} == {(10, 12), (20, 20)}
    assert {tuple(r) for r in survivorship.surviving_rows(table.union(table.filter("run_id = 10"))).collect()} == {(10, 12), (20, 20)}
    golden = {(r.file, r.span_day): r for r in survivorship.golden_runs(table).collect()}
    assert golden["a", ""].smoke_test is True and golden["a", ""].smoke_test_from == 11 and golden["a", ""].results_from == 12 and golden["a", ""].timestamp_utc_from == 12
    assert golden["b", "2018-01-01"].results_from == 20 and golden["b", "2018-02-01"].results_from == 22


def test_whole_records_survive(spark, small):
    keyed = survivorship.run_keys(spark.read.parquet(f"{small}/results.parquet"))
    groups = {}
    for r in keyed.withColumn("us", instant(F.col("timestamp_utc"))).dropna(subset=["file", "span_day", "seed"]).collect():
        groups.setdefault((r.file, r.span_day, r.seed), []).append(r)
    said = lambda t: t is not None and t.strip().lower() not in ("", "none", "null", "nan", "n/a")
    number = lambda r: any(v is not None and v.mape is not None and not math.isnan(v.mape) for v in (r.results or {}).values())
    usable = {"path": lambda r: said(r.path), "smoke_test": lambda r: r.smoke_test is not None, "span_start": lambda r: said(r.span_start), "timestamp_utc": lambda r: r.us is not None, "results": number}
    full = {False: 2, None: 1, True: 0}
    got = {(r.file, r.span_day, r.seed): r for r in LLM.queries["p3_records"](spark, small).collect()}
    assert set(got) == set(groups) and any(len(rows) > 1 for rows in groups.values())
    for key, rows in groups.items():
        for name, ok in usable.items():
            best = max(rows, key=lambda r: (ok(r), number(r), full[r.smoke_test], r.us is not None, r.us or 0, -r.run_id))
            want = (best[name], best.run_id) if ok(best) else (None, None)
            assert repr((got[key][name], got[key][f"{name}_from"])) == repr(want)


def test_awkward_tables(spark):
    rows = [run(1, {"a": config()}), run(1, {"a": config()}), run(2, None, time=None, path=None, smoke=None)]
    clashing = spark.createDataFrame(rows, RESULTS).withColumns({"_id": F.lit(1), "file": F.lit("x"), "value": F.lit(2), "results_from": F.lit(3)})
    kept = survivorship.golden_runs(clashing).collect()
    assert len(kept) == 1 and kept[0].results_from == 1 and kept[0].file == "a" and set(kept[0].results) == {"a"}
    assert survivorship.golden_runs(clashing.limit(0)).count() == survivorship.surviving_rows(clashing.limit(0)).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("run_id"), F.lit("p").alias("path"), F.lit("n.ipynb").alias("notebook"), F.lit(1).cast("bigint").alias("seed"), (F.col("id") % 2 == 0).alias("smoke_test"), F.lit(None).cast("string").alias("span_start"), F.lit("2024-01-01").alias("timestamp_utc"), F.lit(None).cast(spark.createDataFrame([], RESULTS).schema["results"].dataType).alias("results"))
    assert [tuple(r) for r in survivorship.surviving_rows(hot).collect()] == [(0, 1)]


@pytest.mark.parametrize("name", sorted(LLM.sql))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = LLM.queries[name](spark, small)
    columns = sorted(df.columns)
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    cursor = con.execute(LLM.sql[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    want = sorted(repr([plain(r[theirs.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want
