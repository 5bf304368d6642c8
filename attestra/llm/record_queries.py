"""Queries of the surviving records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.llm import survivorship
from attestra.llm.registry import LLM
from attestra.session import table

_RUN_KEYS = r"""
WITH t AS (SELECT *, trim(span_start, ' ' || chr(9) || chr(10) || chr(13)) AS sp, trim(timestamp_utc) AS tx FROM results),
k AS (SELECT *,
  nullif(regexp_replace(regexp_replace(trim(notebook), '^.*[/\\]', ''), '(.)\.[A-Za-z][A-Za-z0-9]{0,9}$', '\1'), '') AS file,
  CASE WHEN sp IS NULL OR lower(sp) IN ('', 'none', 'null', 'nan', 'n/a') THEN ''
    WHEN regexp_full_match(sp, '\d{4}[-/]\d{2}') THEN replace(sp, '/', '-') || '-01'
    WHEN regexp_full_match(sp, '\d{8}') THEN sp[1:4] || '-' || sp[5:6] || '-' || sp[7:8]
    ELSE replace(sp[1:10], '/', '-') END AS span_day,
  CASE WHEN regexp_full_match(tx, '\d{13}') THEN tx::BIGINT * 1000
    WHEN regexp_full_match(tx, '\d{10}') THEN tx::BIGINT * 1000000
    WHEN regexp_full_match(tx, '\w{3}, \d\d \w{3} \d{4} .* GMT') THEN epoch_us(strptime(tx, '%a, %d %b %Y %H:%M:%S GMT'))
    WHEN regexp_full_match(tx, '\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?') THEN epoch_us(replace(tx, 'T', ' ')::TIMESTAMP)
    ELSE epoch_us(try_cast(tx AS TIMESTAMPTZ)) END AS us,
  len(list_filter(map_values(results), lambda v: v.mape IS NOT NULL AND NOT isnan(v.mape))) > 0 AS usable,
  CASE WHEN smoke_test THEN 0 WHEN smoke_test IS NULL THEN 1 ELSE 2 END AS full_run
FROM t)
"""


@LLM.add(
    "p3_found",
    _RUN_KEYS
    + """
, r AS (SELECT run_id, count(*) OVER g AS n, min(run_id) OVER g AS first_run_id,
  row_number() OVER (PARTITION BY file, span_day, seed ORDER BY coalesce(usable, false) DESC, full_run DESC, us DESC NULLS LAST, run_id) AS rk
  FROM k WHERE file IS NOT NULL AND seed IS NOT NULL WINDOW g AS (PARTITION BY file, span_day, seed))
SELECT first_run_id, run_id AS kept_run_id FROM r WHERE n > 1 AND rk = 1
""",
)
def p3_found(spark, folder):
    return survivorship.surviving_rows(table(spark, folder, "results"))


@LLM.add(
    "p3_golden",
    _RUN_KEYS
    + r"""
, m AS (SELECT *, path IS NOT NULL AND NOT regexp_full_match(trim(path), '(?i)|none|null|nan|nat|na|n/a|nil|-|--|unset|unknown|undefined') AS has_path,
  sp IS NOT NULL AND NOT regexp_full_match(sp, '(?i)|none|null|nan|nat|na|n/a|nil|-|--|unset|unknown|undefined') AS has_span, coalesce(usable, false) AS ok FROM k WHERE file IS NOT NULL AND seed IS NOT NULL),
o AS (SELECT *,
  row_number() OVER (PARTITION BY file, span_day, seed ORDER BY has_path DESC, ok DESC, full_run DESC, us DESC NULLS LAST, run_id) AS r_path,
  row_number() OVER (PARTITION BY file, span_day, seed ORDER BY smoke_test IS NOT NULL DESC, ok DESC, full_run DESC, us DESC NULLS LAST, run_id) AS r_smoke,
  row_number() OVER (PARTITION BY file, span_day, seed ORDER BY has_span DESC, ok DESC, full_run DESC, us DESC NULLS LAST, run_id) AS r_span,
  row_number() OVER (PARTITION BY file, span_day, seed ORDER BY us IS NOT NULL DESC, ok DESC, full_run DESC, us DESC NULLS LAST, run_id) AS r_time,
  row_number() OVER (PARTITION BY file, span_day, seed ORDER BY ok DESC, full_run DESC, us DESC NULLS LAST, run_id) AS r_res
  FROM m)
SELECT file, span_day, seed, max(CASE WHEN r_path = 1 AND has_path THEN path END) AS path, max(CASE WHEN r_path = 1 AND has_path THEN run_id END) AS path_from,
  bool_or(CASE WHEN r_smoke = 1 THEN smoke_test END) AS smoke_test, max(CASE WHEN r_smoke = 1 AND smoke_test IS NOT NULL THEN run_id END) AS smoke_test_from,
  max(CASE WHEN r_span = 1 AND has_span THEN span_start END) AS span_start, max(CASE WHEN r_span = 1 AND has_span THEN run_id END) AS span_start_from,
  max(CASE WHEN r_time = 1 AND us IS NOT NULL THEN timestamp_utc END) AS timestamp_utc, max(CASE WHEN r_time = 1 AND us IS NOT NULL THEN run_id END) AS timestamp_utc_from,
  max(CASE WHEN r_res = 1 AND ok THEN list_sort(map_keys(results)) END) AS configs, max(CASE WHEN r_res = 1 AND ok THEN run_id END) AS results_from
FROM o GROUP BY file, span_day, seed
""",
)
def p3_golden(spark, folder):
    """The surviving record of each run; of its results the names of the configurations."""
    golden = survivorship.golden_runs(table(spark, folder, "results"))
    return golden.withColumn("configs", F.array_sort(F.map_keys("results"))).drop("results")


@LLM.add("p3_records")
def p3_records(spark, folder):
    """The surviving record of each run with all of its fields, the results whole."""
    return survivorship.golden_runs(table(spark, folder, "results"))
