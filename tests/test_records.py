"""Nested records, survivorship, drifting schemas and histories, with every awkward case."""

import datetime as dt
import itertools
import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestra.functions import schema_trees as trees
from attestra.functions.forms import instant, notebook_file, written_day
from attestra.operators import drift, history, nested
from attestra.plans.records import RECORDS

RECORD = "struct<rmse:double,mae:double,mape:double,params:bigint,futility_stop:string,folds:array<struct<fold:int,mape:double,stops:array<struct<epoch:int,reason:string>>>>>"
RESULTS = f"run_id bigint, path string, notebook string, seed bigint, smoke_test boolean, span_start string, timestamp_utc string, results map<string,{RECORD}>"


def config(mape=1.0, folds=None):
    return (1.0, 1.0, mape, 10, None, folds)


def run(run_id, results, notebook="a.ipynb", seed=1, smoke=False, span=None, time="2024-01-01T00:00:00Z", path="p"):
    return (run_id, path, notebook, seed, smoke, span, time, results)


NESTED = [
    run(1, {"a": config(folds=[(0, 1.0, [(5, "x"), None, (6, None)]), None, (2, 2.0, [])]), "b": None}),
    run(2, {}), run(3, None), run(4, {"c": config(folds=[None]), "d": config(folds=[(0, None, [None])])}),
    run(None, {"e": config()}, None, None, None, None, None, None),
]


def brute_nodes(rows):
    """Depth-first walk with a counter."""
    out = []
    for r in rows:
        counter = itertools.count(1)

        def walk(kind, children, config="", fold=-1, stop=-1):
            pre = next(counter)
            for child in children:
                walk(*child)
            out.append((r[0], kind, config, fold, stop, pre, next(counter)))

        tree = []
        for name, value in (r[7] or {}).items():
            folds = []
            for i, f in enumerate((value[5] if value else None) or []):
                if f is not None:
                    stops = [("stop", [], name, i, j) for j, s in enumerate(f[2] or []) if s is not None]
                    folds.append(("fold", stops, name, i))
            tree.append(("config", folds, name))
        walk("run", tree)
    return sorted(out, key=str)


def same_as_a_walk(table):
    """Maps keep the order in which they are stored, so the walk goes over the stored rows."""
    names = ("run_id", "path", "notebook", "seed", "smoke_test", "span_start", "timestamp_utc")
    plain = [tuple(r[:7]) + (None if r[7] is None else {k: None if v is None else tuple(v) for k, v in r[7]},) for r in table.select(*names, F.map_entries("results")).collect()]
    got = nested.nodes(table).collect()
    assert sorted(((n.run_id, n.kind, n.config, n.fold_pos, n.stop_pos, n.pre, n.post) for n in got), key=str) == brute_nodes(plain)


def test_nodes_against_a_walk(spark):
    same_as_a_walk(spark.createDataFrame(NESTED, RESULTS))


def test_nodes_of_stored_rows_against_a_walk(spark, small):
    same_as_a_walk(spark.read.parquet(f"{small}/results.parquet"))


def test_leaves_links_and_tables(spark):
    labelled = nested.nodes(spark.createDataFrame(NESTED, RESULTS))
    found = {tuple(r) for r in nested.leaves(labelled).select("run_id", "config", "fold_pos", "stop_pos").collect()}
    assert found == {(1, "a", 0, 0), (1, "a", 0, 2), (1, "a", 2, -1), (1, "b", -1, -1), (2, "", -1, -1), (3, "", -1, -1), (4, "c", -1, -1), (4, "d", 0, -1), (None, "e", -1, -1)}
    stops, configs = labelled.filter("kind = 'stop'"), labelled.filter("kind = 'config'")
    assert nested.contained(stops, configs).count() == 2
    for kind in nested.KINDS:
        table = nested.node_table(labelled, kind)
        assert {"run_id", "notebook", "seed", "parent_pre", "pre", "post"} <= set(table.columns)


def test_nodes_edge_tables(spark):
    empty = spark.createDataFrame([], RESULTS)
    assert nested.nodes(empty).count() == 0
    twice = spark.createDataFrame(NESTED[:1] * 2, RESULTS)
    assert nested.nodes(twice).count() == 2 * nested.nodes(spark.createDataFrame(NESTED[:1], RESULTS)).count()
    clashing = spark.createDataFrame(NESTED, RESULTS).withColumns({"kind": F.lit("x"), "pre": F.lit(1), "config": F.lit(2), "_configs": F.lit(3), "file": F.lit(4), "span_day": F.lit(5)})
    assert nested.nodes(clashing).count() == len(brute_nodes(NESTED))
    wide = spark.createDataFrame([run(1, {f"c{i}": config(folds=[(j, 1.0, [(1, "r")] * 3) for j in range(20)]) for i in range(40)})], RESULTS)
    assert nested.leaves(nested.nodes(wide)).count() == 40 * 20 * 3


def test_many_children(spark):
    rng = random.Random(5)
    for n in (63, 64, 65, 128, 130, 1000):
        folds = [(j, 1.0, [(1, "r")] * rng.randint(0, 3)) if rng.random() < 0.9 else None for j in range(n)]
        rows = [run(1, {"a": config(folds=folds)}), run(2, {f"c{i}": config(folds=folds[: i % 3]) for i in range(n)})]
        same_as_a_walk(spark.createDataFrame(rows, RESULTS))


def test_forms(spark):
    days = {
        "2018-01-01": "2018-01-01", " 2018/1/2 ": "2018-01-02", "20180103": "2018-01-03", "2018-02": "2018-02-01", "2018-01-01T00:00:00+09:00": "2018-01-01", "01 Feb 2024": "2024-02-01",
        "Feb 3, 2024": "2024-02-03", "Thu, 01 Feb 2024 10:00:00 GMT": "2024-02-01", "None": None, "": None, "2018-13-01": None, "2018-02-30": None, "soon": None, "1704067200": "2024-01-01", "3.2.2024": "2024-02-03",
    }
    rows = spark.createDataFrame([(k, v) for k, v in days.items()] + [(None, None)], "t string, want string")
    assert [tuple(r) for r in rows.withColumn("got", written_day(F.col("t"))).filter("not (got <=> want)").collect()] == []
    base = int(dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    times = ["2024-01-01T12:00:00Z", "2024-01-01 12:00:00", "2024-01-01T13:00:00+01:00", "2024-01-01T12:00:00+0000", "Mon, 01 Jan 2024 12:00:00 GMT", "1704110400", "1704110400000", "2024-01-01T12:00:00.000000+00:00", "2024-01-01 07:00:00 -05:00", "1 Jan 2024 14:00:00 +0200"]
    assert {r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(instant(F.col("t"))).collect()} == {base}
    assert {r[0] for r in spark.createDataFrame([("n/a",), ("",), (None,), ("unset",), ("12",), ("2024-99-01T00:00:00Z",)], "t string").select(instant(F.col("t"))).collect()} == {None}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert spark.createDataFrame([("2024-01-01 12:00:00",)], "t string").select(instant(F.col("t"))).first()[0] == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    files = {"a/b/x.ipynb": "x", " ./x.ipynb ": "x", "x": "x", "work\\x.py": "x", "naive.last.ipynb": "naive.last", "": None, "  ": None}
    assert all(r.got == r.want for r in spark.createDataFrame(list(files.items()), "t string, want string").withColumn("got", notebook_file(F.col("t"))).collect())


FILES = "file_id bigint, path string, notebook string, written_at timestamp, landed_at timestamp, body string"


def files_of(spark, bodies, notebook="n"):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, "p", notebook, start + dt.timedelta(hours=i), start, b) for i, b in enumerate(bodies)], FILES)


def body(results="results", params="params", stop=None, **more):
    return json.dumps({"seed": more.pop("seed", 1), results: {c: {"mape": 5.0 + i, params: 1000 * (i + 1)} | ({"futility_stop": stop} if stop != "no" else {}) for i, c in enumerate("ABC")}} | more)


def found(spark, bodies):
    return {tuple(r) for r in drift.schema_changes(files_of(spark, bodies)).select("file_id", "field", "change_kind").collect()}


def test_drift_kinds(spark):
    assert found(spark, [body(), body()]) == set()
    assert found(spark, [body(), body(params="n_params")]) == {(1, "params", "renamed")}
    assert found(spark, [body(), body("scores")]) == {(1, "results", "renamed")}
    assert found(spark, [body(), body(seed="1"), body(seed=None), body(seed="2"), body()]) == {(1, "seed", "retyped"), (4, "seed", "retyped")}
    assert found(spark, [body(), body(env={"x": 1}), body()]) == {(1, "env", "added"), (2, "env", "removed")}
    assert found(spark, [body(), body(stop="no"), body()]) == set()
    assert found(spark, [body(), body(params="Params"), body()]) == {(1, "params", "renamed"), (2, "Params", "renamed")}
    assert found(spark, [body(), body("results", "n_params", device="gpu"), body(device="gpu")]) == {(1, "params", "renamed"), (1, "device", "added"), (2, "n_params", "renamed")}
    listed = json.dumps({"seed": 1, "results": [{"config": c, "mape": 5.0, "params": 1, "futility_stop": None} for c in "ABC"]})
    assert found(spark, [body(), listed, json.dumps({"seed": 1, "results": json.dumps(json.loads(body())["results"])})]) == {(1, "results", "retyped"), (2, "results", "retyped")}


def test_drift_values_decide(spark):
    a = json.dumps({"results": {c: {"mae": 140.0 + i} for i, c in enumerate("ABC")}})
    b = json.dumps({"results": {c: {"val_loss": 0.4} for c in "ABC"}})
    c = json.dumps({"results": {c: {"mean_abs_err": 141.0 + i} for i, c in enumerate("ABC")}})
    assert found(spark, [a, b]) == {(1, "mae", "removed"), (1, "val_loss", "added")}
    assert found(spark, [a, c]) == {(1, "mae", "renamed")}


def test_drift_awkward(spark):
    empty = spark.createDataFrame([], FILES)
    assert drift.schema_changes(empty).count() == 0 and drift.unified_runs(empty).count() == 0
    nan = body().replace("5.0", "NaN")
    rows = files_of(spark, [None, "", "{", "[1]", "null", body(), nan, body() + "x", body("results", "params", **{"extra": "y" * 100_000})])
    assert {tuple(r) for r in drift.schema_changes(rows).select("file_id", "field", "change_kind").collect()} == {(8, "extra", "added")}
    same = rows.union(rows).withColumn("shape", F.lit(1)).withColumn("names", F.lit(2))
    assert {tuple(r) for r in drift.schema_changes(same).select("file_id", "field", "change_kind").collect()} == {(8, "extra", "added")}
    assert drift.schema_changes(rows.withColumn("notebook", F.lit(None).cast("string"))).count() == 0
    table = drift.unified_runs(files_of(spark, [body(), body(params="n_params", seed="7", smoke_test="true"), body("scores", smoke_test=0)]))
    assert {(r.file_id, r.seed, r.config, r.params, r.smoke_test) for r in table.collect()} == {(f, s, c, p, t) for f, s, t in ((0, 1, None), (1, 7, True), (2, 1, False)) for c, p in zip("ABC", (1000, 2000, 3000))}


def brute_changes(bodies):
    """Every file in turn, nothing left out, as the reduced sequence must give too."""
    documents = [(i, trees.shape_of(d)) for i, b in enumerate(bodies) if (d := trees.parsed(b)) is not None]
    return {c[:3] for c in trees.history_of(documents)[0]}


@pytest.mark.parametrize("seed", range(4))
def test_reduction_changes_nothing(spark, seed):
    rng = random.Random(seed)
    bodies = []
    name, container, kind = "params", "results", 1
    for _ in range(60):
        name = rng.choice(["params", "n_params"]) if rng.random() < 0.08 else name
        container = rng.choice(["results", "metrics"]) if rng.random() < 0.05 else container
        kind = rng.choice([1, "1", None]) if rng.random() < 0.1 else kind
        more = {"env": {"a": 1}} if rng.random() < 0.3 else {}
        bodies.append(body(container, name, seed=kind, **more) if rng.random() < 0.95 else "{")
    assert found(spark, bodies) == brute_changes(bodies)


@pytest.mark.parametrize("seed", range(3))
def test_summaries_are_enough(seed):
    """Random stretches of optional, exclusive, moving and renamed fields: the kept files give the history of all."""
    rng = random.Random(seed)
    for _ in range(60):
        names = {"params": "params", "results": "results"}
        documents = []
        for _ in range(rng.randint(1, 60)):
            for old, others in (("params", ["params", "n_params", "param_count"]), ("results", ["results", "metrics"])):
                names[old] = rng.choice(others) if rng.random() < 0.06 else names[old]
            own = {c: {"mape": rng.choice([5.0, None, 5]), names["params"]: 1000 + i} for i, c in enumerate("ABC")}
            more = {n: rng.choice(["x", None, 3, [1]]) for n in ("env", "host", "note") if rng.random() < 0.3}
            place = {"span_start": "2020-01-01"}
            top = {"seed": 1} | more | (place if rng.random() < 0.5 else {})
            if "span_start" not in top and rng.random() < 0.3:
                own = {c: v | place for c, v in own.items()}
            documents.append(top | {names["results"]: own})
        whole = [(i, trees.shape_of(d)) for i, d in enumerate(documents)]
        cuts = sorted(rng.sample(range(len(documents) + 1), min(2, len(documents))))
        kept = []
        for part in (documents[: cuts[0]], documents[cuts[0] : cuts[-1]], documents[cuts[-1] :]):
            stretch = drift._Stretch()
            for d in part:
                stretch.add(("n", None, documents.index(d) if documents.count(d) == 1 else next(i for i, x in enumerate(documents) if x is d)), trees.shape_of(d))
            kept += [(f, json.loads(json.dumps(s))) for _, _, f, s in (stretch.result() if part else [])]
        want, got = trees.history_of(whole), trees.history_of(kept)
        assert sorted(map(str, got[0])) == sorted(map(str, want[0])) and got[1] == want[1]


def test_hot_notebook_leaves_few_files():
    """Optional fields that come and go over thousands of files leave a bounded number for the task that sees them all."""
    rng = random.Random(1)
    sizes = []
    for n in (1000, 4000):
        stretch = drift._Stretch()
        for i in range(n):
            stretch.add(("n", None, i), trees.shape_of({"seed": i, "results": {"A": {"mape": 1.0} | ({"futility_stop": "x"} if rng.random() < 0.4 else {})}} | {k: 1 for k in ("env", "host", "note", "tag") if rng.random() < 0.3}))
        sizes.append(len(stretch.result()))
    assert max(sizes) < 80


def test_moves(spark):
    top = {"seed": 1, "span_start": "2020-01-01T00:00", "results": {c: {"mape": 5.0 + i} for i, c in enumerate("ABC")}}
    moved = {"seed": 1, "results": {c: {"mape": 5.0 + i, "span_start": "2020-01-01T00:00"} for i, c in enumerate("ABC")}}
    renamed = {"seed": 1, "results": {c: {"mape": 5.0 + i, "span_begin": "2020-01-01T00:00"} for i, c in enumerate("ABC")}}
    kinds = lambda *ds: {tuple(r) for r in drift.schema_changes(files_of(spark, [json.dumps(d) for d in ds])).select("file_id", "field", "change_kind", "renamed_to").collect()}
    assert kinds(top, moved) == {(1, "span_start", "moved", None)}
    assert kinds(top, renamed) == {(1, "span_start", "moved", "span_begin"), (1, "span_start", "renamed", "span_begin")}
    cost, script = trees.edit_script(trees.shape_of(top), trees.shape_of(moved))
    assert cost == trees.MOVE and script == [("move", "span_start", "span_start")]


def test_evidence_is_whole(spark):
    """What tells two fields apart may stand after any number of characters, forms and keys."""
    forms = lambda tail: ["w" * 50 + str(i) * (i % 2) + tail for i in range(8)]
    a, b = trees._evidence(enumerate(forms("-x"))), trees._evidence(enumerate(forms("_1.y")))
    assert not set(a["f"]) & set(b["f"]) and len(trees._evidence([("", {f"k{i}": 1 for i in range(90)})])["k"]) == 90


def test_assignment_is_least():
    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        costs = [[rng.choice([0.3, 0.7, 1.1, 1.9, 2.0, 2.5]) for _ in range(m)] for _ in range(n)]
        got = trees.assignment(costs)
        price = lambda pick: sum(costs[i][j] if j >= 0 else 2.0 for i, j in enumerate(pick))
        best = min(price(p) for p in itertools.product(range(-1, m), repeat=n) if len([j for j in p if j >= 0]) == len({j for j in p if j >= 0}))
        assert abs(price(got) - best) < 1e-9


@given(st.text(max_size=12), st.text(max_size=12))
@settings(max_examples=200, deadline=None)
def test_name_likeness_is_bounded(a, b):
    assert 0 <= trees.name_likeness(a, b) <= 1 and trees.name_likeness(a, a) == 1.0


PAPERS = "paperid string, row_id bigint, citationcount bigint, _fetched string"


def test_citation_history(spark):
    rows = [
        ("a", 1, 5, "2024-01-01"), ("a", 2, 6, "2024-01-01T10:00:00Z"), ("a", 3, 6, "2024/01/05"), ("a", 4, 7, "20240107"), ("a", 5, 6, "08 Jan 2024"), ("a", 6, None, "2024-01-09"), ("a", 7, -1, "2024-01-10"), ("a", 8, 9, "unknown"),
        ("b", 9, 0, "2024-02-01"), (None, 10, 1, "2024-02-01"), ("c", 11, 3, None),
    ]
    got = {tuple(r) for r in history.citation_history(spark.createDataFrame(rows, PAPERS)).select("paperid", "valid_from", "valid_to").collect()}
    assert got == {("a", "2024-01-01", "2024-01-07"), ("a", "2024-01-07", "2024-01-08"), ("a", "2024-01-08", "9999-12-31"), ("b", "2024-02-01", "9999-12-31")}
    table = spark.createDataFrame(rows, PAPERS)
    doubled = table.union(table).withColumns({"day": F.lit("x"), "_n": F.lit(1), "change": F.lit(2), "valid_from": F.lit(3)})
    assert {tuple(r) for r in history.citation_history(doubled).select("paperid", "valid_from", "valid_to").collect()} == got
    assert history.citation_history(table.limit(0)).count() == 0
    assert history.as_of(history.citation_history(table), "2024-01-07").count() == 1


def test_snapshot_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w"), (None, None)], "k int, v string")
    got = {(r.k, r.change, r.v_before, r.v_after) for r in history.snapshot_diff(a, b, ["k"], ["v"]).collect()}
    assert got == {(2, "changed", None, "y"), (3, "deleted", "z", None), (4, "inserted", None, "w"), (None, "changed", "n", None)}
    assert history.snapshot_diff(a, a, ["k"], ["v"]).count() == 0
