"""Paired statistics: known values and brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from attestra.functions import stats
from attestra.operators import study
from attestra.plans.studies import STUDIES

RUNS = "path string, notebook string, span_start string, seed bigint, smoke_test boolean, timestamp_utc string, results map<string,struct<rmse:double,mae:double,mape:double,params:bigint,futility_stop:string>>"


def result(seed, values, time="2024-01-01", smoke=False, path=None, notebook="n.ipynb", span=None):
    return (path or f"runs/{seed}", notebook, span, seed, smoke, time, {k: (v, v, v, 10, None) for k, v in values.items()})


def cube(spark, rows):
    return study.cube(study.supersede(study.with_study(spark.createDataFrame(rows, RUNS))))


def constant(spark, offset, n):
    return cube(spark, [result(s, {"A": 3.0 + 0.01 * s, "B": 3.0 + 0.01 * s + offset}) for s in range(n)])


def test_signed_rank_values():
    assert stats.signed_rank_exact([1, 2, 3, 4, 5], [1] * 5) == pytest.approx(0.0625)
    assert stats.signed_rank_exact(list(range(1, 9)), [1] * 8) == pytest.approx(0.0078125)
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randint(1, 9)
        ranks = [rng.choice([1, 1.5, 2.5, 4]) for _ in range(n)]
        signs = [rng.choice([1, -1]) for _ in range(n)]
        plus = sum(r for r, s in zip(ranks, signs) if s > 0)
        sums = [sum(r for r, s in zip(ranks, p) if s > 0) for p in itertools.product([1, -1], repeat=n)]
        want = min(1.0, 2 * min(sum(x <= plus + 1e-9 for x in sums), sum(x >= plus - 1e-9 for x in sums)) / len(sums))
        assert stats.signed_rank_exact(ranks, signs) == pytest.approx(want)


def test_student():
    assert stats.t_quantile(0.975, 9) == pytest.approx(2.2621571627, abs=1e-8)
    assert stats.t_quantile(0.975, 1) == pytest.approx(12.7062047364, abs=1e-7)
    assert 2 * stats.t_upper(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)
    for df in (1, 2, 7, 30):
        assert stats.t_upper(0.0, df) == pytest.approx(0.5)
        assert stats.t_upper(-1.3, df) == pytest.approx(1 - stats.t_upper(1.3, df))


def test_supersede_takes_the_whole_newest_run(spark):
    rows = [result(1, {"A": 3.0, "B": 4.0}, "2024-01-01"), result(1, {"A": 4.0}, "2024-02-01"), result(2, {"A": 6.0}, smoke=True), result(3, {"A": float("nan"), "B": 1.0}), result(None, {"A": 2.0}), result(None, {"A": 9.0}, "2023")]
    got = {(r.seed, r.config, r.mape) for r in cube(spark, rows).collect()}
    assert got == {(1, "A", 4.0), (3, "B", 1.0), (None, "A", 2.0)}
    ties = [result(1, {"A": 1.0}, path="b"), result(1, {"A": 2.0}, path="a")]
    assert [r.mape for r in cube(spark, ties).collect()] == [2.0]


def test_study_names(spark):
    rows = spark.createDataFrame([result(1, {}, notebook="d/x.y.ipynb", span="s"), result(1, {}, notebook="x", span=""), result(1, {}, notebook=None)], RUNS)
    assert {r.study for r in study.with_study(rows).collect()} == {"d/x.y@s", "x"}
    mapped = spark.createDataFrame([("x", None, "S"), ("d/x.y.ipynb", "s", None)], "notebook string, span string, study string")
    assert [r.study for r in study.with_study(rows, mapped).collect()] == ["S"]


def test_constant_offset(spark):
    tested = study.pair_tests(study.pairs_of(constant(spark, 0.5, 5)), tost_margin=0.3).first()
    assert tested.n == 5 and tested.mean_diff == pytest.approx(-0.5) and tested.w_p == pytest.approx(0.0625)
    equal = study.pair_tests(study.pairs_of(constant(spark, 0.0, 5)), tost_margin=0.3).first()
    assert equal.w_p == 1.0 and equal.t_p == 1.0 and equal.tost_p == 0.0 and equal.dz is None and equal.ci_lo == equal.ci_hi == 0.0
    few = study.pair_tests(study.pairs_of(constant(spark, 0.5, 2))).first()
    assert few.w_p is None and few.t_p is None and "only 2 shared" in few.note


def test_jittered(spark):
    rows = [result(s, {"A": 3.0 + 0.01 * s, "B": 3.5 + 0.01 * s + (0.01 if s % 2 else -0.01)}) for s in range(8)]
    r = study.pair_tests(study.pairs_of(cube(spark, rows))).first()
    assert r.w_p == pytest.approx(0.0078125) and r.t_p < 1e-6 and r.ci_lo < -0.5 < r.ci_hi
    assert study.verdicts(study.holm(study.pair_tests(study.pairs_of(cube(spark, rows))))).first().winner == "A"


def test_ranks_against_brute_force(spark):
    rng = random.Random(7)
    rows = [("s", "a", "b", i, 0.0, 0.0, rng.choice([-3, -2, -1, 0, 1, 2, 3]) / 2) for i in range(300)] + [("t", "a", "b", i, 0.0, 0.0, rng.gauss(0.1, 1)) for i in range(400)] + [("u", "a", "b", 1, 0.0, 0.0, 0.0)]
    got = {r.study: r for r in study.signed_ranks(spark.createDataFrame(rows, "study string, a string, b string, seed int, xa double, xb double, d double")).collect()}
    assert set(got) == {"s", "t"}
    for name in got:
        d = [r[6] for r in rows if r[0] == name and r[6] != 0]
        order = sorted(abs(x) for x in d)
        rank = {m: (order.index(m) + 1 + order.index(m) + order.count(m)) / 2 for m in set(order)}
        assert got[name].n_nonzero == len(d) and got[name].w_plus == pytest.approx(sum(rank[abs(x)] for x in d if x > 0))
        assert 0 <= got[name].w_p <= 1


def test_holm(spark):
    rows = spark.createDataFrame([("s", "a", "b", 0.001), ("s", "a", "c", 0.04), ("s", "b", "c", 0.5), ("s", "c", "d", None)], "study string, a string, b string, w_p double")
    got = {(r.a, r.b): (r.holm_threshold, r.holm_reject) for r in study.holm(rows).collect()}
    assert got["a", "b"] == (pytest.approx(0.05 / 3), True) and got["a", "c"] == (pytest.approx(0.025), False) and got["b", "c"] == (pytest.approx(0.05), False) and got["c", "d"] == (None, None)


def test_holm_and_verdicts_judge_the_signed_ranks(spark, tmp_path):
    rng = random.Random(3)
    offset = {"A": 0.0, "B": 0.4, "C": 0.05, "D": 3.0}
    values = {("m", s): {k: 5 + o + rng.gauss(0, 0.1) for k, o in offset.items()} for s in range(8)}
    values |= {("n", s): {"A": 3 + rng.gauss(0, 0.01), "B": 9 + rng.gauss(0, 0.01)} for s in range(5)}
    values |= {("o", s): {"A": 3.0 + s, "B": 9.0} for s in range(2)} | {("p", s): {"A": 5 + rng.gauss(0, 3), "B": 5 + rng.gauss(0, 3)} for s in range(6)}
    spark.createDataFrame([result(s, v, notebook=n, path=f"{n}/{s}") for (n, s), v in values.items()], RUNS).write.parquet(str(tmp_path / "results.parquet"))
    spark.createDataFrame([(n, None, n) for n in "mnop"], "notebook string, span string, study string").write.parquet(str(tmp_path / "studies.parquet"))

    def signed(d):
        order = sorted(abs(x) for x in d)
        ranks = [order.index(abs(x)) + 1 for x in d]
        plus = sum(r for r, x in zip(ranks, d) if x > 0)
        sums = [sum(r for r, keep in zip(ranks, p) if keep) for p in itertools.product([0, 1], repeat=len(d))]
        return min(1.0, 2 * min(sum(x <= plus for x in sums), sum(x >= plus for x in sums)) / len(sums))

    def tost(d):
        mean = sum(d) / len(d)
        se = math.sqrt(sum((x - mean) ** 2 for x in d) / (len(d) - 1) / len(d))
        return max(stats.t_upper((mean + 0.5) / se, len(d) - 1), stats.t_upper((0.5 - mean) / se, len(d) - 1))

    want, thresholds = {}, {}
    for n in "mnop":
        rows = [v for (name, _), v in values.items() if name == n]
        diffs = {(a, b): [v[a] - v[b] for v in rows] for a, b in itertools.combinations(sorted(rows[0]), 2)}
        p = {k: signed(d) for k, d in diffs.items() if len(d) >= 3}
        rejecting = True
        for rank, k in enumerate(sorted(p, key=lambda k: (p[k], k))):
            thresholds[n, *k] = 0.05 / (len(p) - rank)
            rejecting = rejecting and p[k] <= thresholds[n, *k]
            want[n, *k] = "significant" if rejecting else "equivalent" if tost(diffs[k]) <= 0.05 else "inconclusive"
        want |= {(n, *k): "too few seeds" for k in diffs if k not in p}
    assert set(want.values()) == {"significant", "equivalent", "inconclusive", "too few seeds"}
    got = STUDIES.queries["verdicts"](spark, str(tmp_path)).collect()
    assert {(r.study, r.a, r.b): r.verdict for r in got} == want
    row = next(r for r in got if r.study == "n")
    assert row.w_p == pytest.approx(0.0625) and row.verdict == "inconclusive"  # the paired t alone would decide
    held = STUDIES.queries["holm_adjust"](spark, str(tmp_path)).collect()
    assert {(r.study, r.a, r.b): r.holm_threshold for r in held} == pytest.approx(thresholds)
    assert {(r.study, r.a, r.b) for r in held if r.holm_reject} == {k for k, v in want.items() if v == "significant"}


def test_battery_and_listing(spark):
    rows = [result(s, {"base": 9.0, "A": 1.0, "B": 2.0}) for s in range(3)]
    own = cube(spark, rows)
    assert {(r.a, r.b) for r in study.default_battery(own, ["base"]).collect()} == {("A", "B"), ("A", "base")}
    listed = study.listing(own).first()
    assert listed.seeds == [0, 1, 2] and listed.configs == ["A", "B", "base"]
    assert [r[0] for r in spark.createDataFrame([(0.00001,), (0.0625,)], "p double").select(study.format_p(F.col("p"))).collect()] == ["1.0e-05", "0.0625"]


def test_empty(spark):
    own = cube(spark, [])
    assert study.pair_tests(study.pairs_of(own), tost_margin=0.1).count() == 0 and study.listing(own).count() == 0
    assert math.isinf(study.config_means(spark.createDataFrame([("s", 1, "A", float("nan"))], "study string, seed int, config string, mape double")).first()["mean"])
