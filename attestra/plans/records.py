"""Queries of the record operators: nested records, drifting schemas, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import drift, history, nested
from attestra.plans.registry import Registry
from attestra.session import table

RECORDS = Registry()

_CONFIGS = """
WITH c AS (SELECT run_id, notebook, seed, unnest(map_entries(results)) AS e FROM results),
cf AS (SELECT run_id, notebook, seed, e.key AS config, e.value AS v FROM c),
fp AS (SELECT run_id, notebook, seed, config, v.folds AS folds, unnest(range(len(v.folds))) AS fold_pos FROM cf),
fo AS (SELECT run_id, notebook, seed, config, fold_pos, folds[fold_pos + 1] AS f FROM fp WHERE folds[fold_pos + 1] IS NOT NULL),
sp AS (SELECT run_id, notebook, seed, config, fold_pos, f.stops AS stops, unnest(range(len(f.stops))) AS stop_pos FROM fo),
st AS (SELECT run_id, notebook, seed, config, fold_pos, stop_pos, stops[stop_pos + 1] AS s FROM sp WHERE stops[stop_pos + 1] IS NOT NULL)
"""

_FOUND_2 = (
    _CONFIGS
    + """
SELECT run_id, config, fold_pos::INT AS fold_pos, stop_pos::INT AS stop_pos FROM st
UNION ALL
SELECT run_id, config, fold_pos::INT, -1 FROM fo WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.run_id = fo.run_id AND st.config = fo.config AND st.fold_pos = fo.fold_pos)
UNION ALL
SELECT run_id, config, -1, -1 FROM cf WHERE NOT EXISTS (SELECT 1 FROM fo WHERE fo.run_id = cf.run_id AND fo.config = cf.config)
UNION ALL
SELECT run_id, '', -1, -1 FROM results r WHERE NOT EXISTS (SELECT 1 FROM cf WHERE cf.run_id = r.run_id)
"""
)


@RECORDS.add("p2_found", _FOUND_2)
def p2_found(spark, folder):
    labelled = nested.nodes(table(spark, folder, "results"), keep=("run_id",), values=False)
    return nested.leaves(labelled).select("run_id", "config", "fold_pos", "stop_pos")


# Interval labels: enter and leave numbers from the nodes below and the earlier children.
_LABELS = (
    _CONFIGS
    + """
, fs AS (SELECT fo.*, 1 + (SELECT count(*) FROM st WHERE st.run_id = fo.run_id AND st.config = fo.config AND st.fold_pos = fo.fold_pos) AS sz FROM fo),
cs AS (SELECT cf.*, 1 + coalesce((SELECT sum(sz) FROM fs WHERE fs.run_id = cf.run_id AND fs.config = cf.config), 0) AS sz FROM cf),
cp AS (SELECT cs.*, list_position(map_keys(r.results), cs.config) AS place FROM cs JOIN results r ON r.run_id = cs.run_id),
c2 AS (SELECT *, (2 + coalesce(sum(2 * sz) OVER (PARTITION BY run_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pre FROM cp),
f2 AS (SELECT fs.*, c2.pre AS parent_pre, (c2.pre + 1 + coalesce(sum(2 * fs.sz) OVER (PARTITION BY fs.run_id, fs.config ORDER BY fs.fold_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pre FROM fs JOIN c2 ON c2.run_id = fs.run_id AND c2.config = fs.config),
s2 AS (SELECT st.*, f2.pre AS parent_pre, (f2.pre + 1 + 2 * (row_number() OVER (PARTITION BY st.run_id, st.config, st.fold_pos ORDER BY st.stop_pos) - 1))::BIGINT AS pre FROM st JOIN f2 ON f2.run_id = st.run_id AND f2.config = st.config AND f2.fold_pos = st.fold_pos)
"""
)


@RECORDS.add(
    "p2_configs",
    _LABELS + "SELECT run_id, notebook, seed, 1::BIGINT AS parent_pre, pre, (pre + 2 * sz - 1)::BIGINT AS post, config, v.rmse AS rmse, v.mae AS mae, v.mape AS mape, v.params AS params, v.futility_stop AS futility_stop FROM c2",
)
def p2_configs(spark, folder):
    return nested.node_table(nested.nodes(table(spark, folder, "results")), "config")


@RECORDS.add(
    "p2_folds",
    _LABELS + "SELECT run_id, notebook, seed, parent_pre, pre, (pre + 2 * sz - 1)::BIGINT AS post, config, fold_pos::INT AS fold_pos, f.fold AS fold, f.mape AS mape FROM f2",
)
def p2_folds(spark, folder):
    return nested.node_table(nested.nodes(table(spark, folder, "results")), "fold")


@RECORDS.add(
    "p2_stops",
    _LABELS + "SELECT run_id, notebook, seed, parent_pre, pre, pre + 1 AS post, config, fold_pos::INT AS fold_pos, stop_pos::INT AS stop_pos, s.epoch AS epoch, s.reason AS reason FROM s2",
)
def p2_stops(spark, folder):
    return nested.node_table(nested.nodes(table(spark, folder, "results")), "stop")


@RECORDS.add(
    "p2_stop_configs",
    _CONFIGS + "SELECT run_id, config, count(*) AS stops FROM st GROUP BY ALL",
)
def p2_stop_configs(spark, folder):
    """Stops of each configuration, linked by interval containment alone."""
    labelled = nested.nodes(table(spark, folder, "results"))
    configs, stops = (labelled.filter(F.col("kind") == k) for k in ("config", "stop"))
    links = nested.contained(stops, configs)
    return links.join(configs.select("run_id", F.col("pre").alias("outer_pre"), "config"), ["run_id", "outer_pre"]).groupBy("run_id", "config").agg(F.count(F.lit(1)).alias("stops"))


_OBSERVED = r"""
WITH t AS (SELECT paperid, row_id, citationcount, trim(_fetched) AS f FROM papers WHERE paperid IS NOT NULL AND citationcount >= 0),
d AS (SELECT paperid, row_id, citationcount, CASE
    WHEN regexp_full_match(f, '\d{4}[-/]\d\d[-/]\d\d.*') THEN replace(f[1:10], '/', '-')
    WHEN regexp_full_match(f, '\d{8}') THEN f[1:4] || '-' || f[5:6] || '-' || f[7:8]
    WHEN regexp_full_match(f, '\d\d? \w{3} \d{4}') THEN strftime(strptime(f, '%d %b %Y'), '%Y-%m-%d') END AS day FROM t),
o AS (SELECT paperid, day, arg_max(citationcount, row_id) AS n FROM d WHERE day IS NOT NULL GROUP BY ALL),
v AS (SELECT *, lag(n) OVER (PARTITION BY paperid ORDER BY day) AS p FROM o),
b AS (SELECT * FROM v WHERE p IS NULL OR p <> n)
"""


@RECORDS.add(
    "p6_found",
    _OBSERVED + "SELECT paperid, day AS valid_from, coalesce(lead(day) OVER (PARTITION BY paperid ORDER BY day), '9999-12-31') AS valid_to FROM b",
)
def p6_found(spark, folder):
    return history.citation_history(table(spark, folder, "papers")).select("paperid", "valid_from", "valid_to")


@RECORDS.add(
    "p6_history",
    _OBSERVED + "SELECT paperid, n AS citationcount, day AS valid_from, coalesce(lead(day) OVER (PARTITION BY paperid ORDER BY day), '9999-12-31') AS valid_to FROM b",
)
def p6_history(spark, folder):
    return history.citation_history(table(spark, folder, "papers"))


@RECORDS.add("p6_changes", _OBSERVED + "SELECT paperid, day, CASE WHEN lag(n) OVER w IS NULL THEN 'inserted' ELSE 'changed' END AS change, lag(n) OVER w AS citationcount_before, n AS citationcount_after FROM b WINDOW w AS (PARTITION BY paperid ORDER BY day)")
def p6_changes(spark, folder):
    return history.change_log(history.citation_history(table(spark, folder, "papers")), "paperid", ["citationcount"])


@RECORDS.add(
    "p6_snapshots",
    _OBSERVED
    + """, m AS (SELECT paperid, day[1:4]::INT * 12 + day[6:7]::INT - 1 AS month, arg_max(n, day) AS n FROM o GROUP BY 1, 2),
z AS (SELECT paperid, month + 1 AS month, n FROM m WHERE month < (SELECT max(month) FROM m))
SELECT coalesce(m.paperid, z.paperid) AS paperid, coalesce(m.month, z.month) AS month, CASE WHEN z.paperid IS NULL THEN 'inserted' WHEN m.paperid IS NULL THEN 'deleted' ELSE 'changed' END AS change, z.n AS citationcount_before, m.n AS citationcount_after
FROM m FULL OUTER JOIN z ON m.paperid = z.paperid AND m.month = z.month WHERE m.n IS DISTINCT FROM z.n""",
)
def p6_snapshots(spark, folder):
    """Each month's fetches as a snapshot: what is new, has another count or is gone against the month before."""
    return history.snapshot_changes(history.monthly_counts(table(spark, folder, "papers")), "paperid", "month", ["citationcount"])


@RECORDS.add("p4_found")
def p4_found(spark, folder):
    changes = drift.schema_changes(table(spark, folder, "run_files"))
    return changes.filter("change_kind <> 'moved'").select("file_id", "field", "change_kind")


@RECORDS.add("p4_changes")
def p4_changes(spark, folder):
    return drift.schema_changes(table(spark, folder, "run_files"))


@RECORDS.add("p4_runs")
def p4_runs(spark, folder):
    return drift.unified_runs(table(spark, folder, "run_files"))
