"""Queries of the statistics, claims, integrity and profile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import text
from attestra.operators import claims, integrity, profile, study
from attestra.plans.registry import Registry
from attestra.session import cut_lineage, table
from attestra.sources import files

STUDIES = Registry()

EXPECT = ["small_A", "small_B", "big_baseline", "MTGNN"]
ANCHORS = {"small_A": 12000, "small_B": 18131}
BASELINES = ["big_baseline", "linear", "naive.last"]

_RUNS = """
WITH named AS (SELECT r.*, s.study FROM results r JOIN studies s ON s.notebook = r.notebook AND coalesce(s.span, '') = coalesce(r.span_start, '') WHERE s.study IS NOT NULL),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study, seed ORDER BY coalesce(timestamp_utc, '') DESC, coalesce(path, '')) AS rn FROM named WHERE NOT coalesce(smoke_test, false)) WHERE rn = 1),
e AS (SELECT study, seed, unnest(map_entries(results)) AS e FROM newest),
cube AS (SELECT study, seed, e.key AS config, e.value.mape AS mape, e.value.rmse AS rmse, e.value.mae AS mae, e.value.params AS params FROM e WHERE e.value.mape IS NOT NULL AND NOT isnan(e.value.mape))
"""
_PAIRS = (
    _RUNS
    + """
, pairs AS (SELECT l.study, l.config AS a, r.config AS b, l.seed, l.mape AS xa, r.mape AS xb, l.mape - r.mape AS d FROM cube l JOIN cube r ON l.study = r.study AND l.seed IS NOT DISTINCT FROM r.seed AND l.config < r.config),
eff0 AS (SELECT study, a, b, count(*) AS n, avg(xa) AS mean_a, avg(xb) AS mean_b, median(d) AS median_diff, avg(d) AS mean_diff,
  CASE WHEN count(*) > 1 THEN CASE WHEN min(d) = max(d) THEN 0.0 ELSE stddev_samp(d) END END AS sd, max(abs(d)) = 0 AS all_zero FROM pairs GROUP BY ALL),
eff AS (SELECT *, CASE WHEN sd > 0 THEN mean_diff / sd END AS dz, CASE WHEN sd > 0 THEN mean_diff / (sd / sqrt(n)) END AS t, n - 1 AS df FROM eff0)
"""
)


def _inside(t: str, df: str) -> str:
    """Share of Student's t between -t and t for whole degrees of freedom, by the finite series."""
    th = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({th}) * list_sum(list_transform(range(0, ({df}) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos({th}), 2 * j)))"
    odd = f"2 / pi() * ({th} + CASE WHEN {df} > 1 THEN sin({th}) * list_sum(list_transform(range(0, ({df} - 1) // 2), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos({th}), 2 * j + 1))) ELSE 0 END)"
    return f"CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END"


_TESTS = (
    _PAIRS
    + f"""
, tested AS (SELECT *, CASE WHEN n >= 3 THEN CASE WHEN all_zero THEN 1.0 WHEN sd = 0 THEN 0.0 ELSE 1 - ({_inside("t", "df")}) END END AS t_p FROM eff)
"""
)


def _named(spark, folder):
    return study.with_study(table(spark, folder, "results"), table(spark, folder, "studies"))


def _cube(spark, folder):
    return study.cube(study.supersede(_named(spark, folder)))


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@STUDIES.add("study_named", "SELECT s.study, count(*) AS runs FROM results r JOIN studies s ON s.notebook = r.notebook AND coalesce(s.span, '') = coalesce(r.span_start, '') WHERE s.study IS NOT NULL GROUP BY 1")
def study_named(spark, folder):
    return _named(spark, folder).groupBy("study").agg(F.count(F.lit(1)).alias("runs"))


@STUDIES.add(
    "study_auto",
    r"SELECT regexp_replace(notebook, '([^/.])\.[^./]*$', '\1') || CASE WHEN coalesce(span_start, '') <> '' THEN '@' || span_start ELSE '' END AS study, count(*) AS runs FROM results WHERE notebook IS NOT NULL GROUP BY 1",
)
def study_auto(spark, folder):
    return study.with_study(table(spark, folder, "results")).groupBy("study").agg(F.count(F.lit(1)).alias("runs"))


@STUDIES.add("study_supersede", _RUNS + "SELECT study, seed, run_id, path, timestamp_utc FROM newest")
def study_supersede(spark, folder):
    return study.supersede(_named(spark, folder)).select("study", "seed", "run_id", "path", "timestamp_utc")


@STUDIES.add("study_cube", _RUNS + "SELECT * FROM cube")
def study_cube(spark, folder):
    return _cube(spark, folder)


@STUDIES.add("study_listing", _RUNS + "SELECT study, list_sort(coalesce(list(DISTINCT seed) FILTER (WHERE seed IS NOT NULL), [])) AS seeds, list_sort(list(DISTINCT config)) AS configs FROM cube GROUP BY 1")
def study_listing(spark, folder):
    return study.listing(_cube(spark, folder))


@STUDIES.add("config_means", _RUNS + "SELECT study, config, round(avg(mape), 9) AS mean, count(*) AS seeds FROM cube GROUP BY 1, 2")
def config_means(spark, folder):
    return _rounded(study.config_means(_cube(spark, folder)), "mean", digits=9)


@STUDIES.add("pair_effects", _PAIRS + "SELECT study, a, b, n, all_zero, round(mean_a, 9) AS mean_a, round(mean_b, 9) AS mean_b, round(median_diff, 6) AS median_diff, round(mean_diff, 9) AS mean_diff, round(sd, 6) AS sd, round(dz, 5) AS dz FROM eff")
def pair_effects(spark, folder):
    effects = study.pair_effects(study.pairs_of(_cube(spark, folder)))
    return _rounded(_rounded(_rounded(effects, "mean_a", "mean_b", "mean_diff", digits=9), "median_diff", "sd"), "dz", digits=5)


@STUDIES.add(
    "pair_t_tost",
    _TESTS
    + f"""
, s AS (SELECT *, sd / sqrt(n) AS se FROM tested),
u AS (SELECT *, ({_inside("((mean_diff + 0.5) / se)", "df")}) AS lo_in, ({_inside("((0.5 - mean_diff) / se)", "df")}) AS hi_in FROM s)
SELECT study, a, b, n, round(t_p, 6) AS t_p, CASE WHEN n >= 3 THEN t_p > 0.05 END AS covers_zero,
  round(CASE WHEN n >= 3 THEN CASE WHEN sd = 0 THEN CASE WHEN abs(mean_diff) < 0.5 THEN 0.0 ELSE 1.0 END
    ELSE greatest(CASE WHEN mean_diff + 0.5 >= 0 THEN (1 - lo_in) / 2 ELSE (1 + lo_in) / 2 END, CASE WHEN 0.5 - mean_diff >= 0 THEN (1 - hi_in) / 2 ELSE (1 + hi_in) / 2 END) END END, 6) AS tost_p FROM u
""",
)
def pair_t_tost(spark, folder):
    tested = study.pair_tests(study.pairs_of(_cube(spark, folder)), tost_margin=0.5)
    covers = F.when(F.col("n") >= 3, (F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0))
    return _rounded(tested.select("study", "a", "b", "n", "t_p", covers.alias("covers_zero"), "tost_p"), "t_p", "tost_p")


@STUDIES.add(
    "pair_signed_ranks",
    _PAIRS
    + """
, z AS (SELECT study, a, b, d, abs(d) AS m, rank() OVER (PARTITION BY study, a, b ORDER BY abs(d)) AS r, count(*) OVER (PARTITION BY study, a, b, abs(d)) AS t FROM pairs WHERE d <> 0)
SELECT study, a, b, count(*) AS n_nonzero, coalesce(sum(r + (t - 1) / 2.0) FILTER (WHERE d > 0), 0)::DOUBLE AS w_plus FROM z GROUP BY ALL
""",
)
def pair_signed_ranks(spark, folder):
    return study.signed_ranks(study.pairs_of(_cube(spark, folder))).drop("w_p")


# Doubled midranks are whole numbers, so the exact distribution is a list of ways for each sum. Larger groups
# have the normal approximation, whose error function is a sum of positive terms.
_WILCOXON = (
    _TESTS
    + f"""
, s AS (SELECT *, sd / sqrt(n) AS se FROM tested),
u AS (SELECT *, ({_inside("((mean_diff + 0.5) / se)", "df")}) AS lo_in, ({_inside("((0.5 - mean_diff) / se)", "df")}) AS hi_in FROM s),
to_p AS (SELECT study, a, b, CASE WHEN n >= 3 THEN CASE WHEN sd = 0 THEN CASE WHEN abs(mean_diff) < 0.5 THEN 0.0 ELSE 1.0 END
    ELSE greatest(CASE WHEN mean_diff + 0.5 >= 0 THEN (1 - lo_in) / 2 ELSE (1 + lo_in) / 2 END, CASE WHEN 0.5 - mean_diff >= 0 THEN (1 - hi_in) / 2 ELSE (1 + hi_in) / 2 END) END END AS tost_p FROM u),
z AS (SELECT study, a, b, d, 2 * rank() OVER (PARTITION BY study, a, b ORDER BY abs(d)) + count(*) OVER (PARTITION BY study, a, b, abs(d)) - 1 AS r2, count(*) OVER (PARTITION BY study, a, b, abs(d)) AS t FROM pairs WHERE d <> 0),
g AS (SELECT study, a, b, count(*) AS k, list(r2::INT) AS rs, sum(r2)::INT AS total, coalesce(sum(r2) FILTER (WHERE d > 0), 0)::INT AS plus, sum(t * t - 1) AS ties FROM z GROUP BY ALL),
ex AS (SELECT *, list_reduce(list_transform(rs, lambda r: [r::DOUBLE]), lambda acc, r: list_transform(range(1, total + 2), lambda i: acc[i] + CASE WHEN i > r[1]::INT THEN acc[i - r[1]::INT] ELSE 0.0::DOUBLE END),
    list_transform(range(0, total + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS ways FROM g WHERE k <= CASE WHEN ties = 0 THEN 50 ELSE 25 END),
wp AS (SELECT study, a, b, least(1.0::DOUBLE, 2 * least(list_sum(ways[1:plus + 1]), list_sum(ways[plus + 1:total + 1])) / pow(2.0::DOUBLE, k)) AS w_p FROM ex
  UNION ALL SELECT study, a, b, 1 - coalesce(list_sum(list_transform(range(0, 400), lambda i: exp(-x * x + (2 * i + 1) * ln(x) - lgamma(i + 1.5)))), 0) FROM
    (SELECT *, abs(plus / 2.0 - k * (k + 1) / 4.0) / sqrt((k * (k + 1) * (2.0 * k + 1) - ties / 2.0) / 24) / sqrt(2.0) AS x FROM g WHERE k > CASE WHEN ties = 0 THEN 50 ELSE 25 END)),
judged AS (SELECT e.*, to_p.tost_p, CASE WHEN e.n >= 3 THEN CASE WHEN e.all_zero THEN 1.0 ELSE wp.w_p END END AS w_p FROM tested e LEFT JOIN to_p USING (study, a, b) LEFT JOIN wp USING (study, a, b)),
ranked AS (SELECT study, a, b, w_p, row_number() OVER (PARTITION BY study ORDER BY w_p, a, b) AS rk, count(*) OVER (PARTITION BY study) AS m FROM judged WHERE w_p IS NOT NULL),
thr AS (SELECT *, 0.05::DOUBLE / (m - rk + 1) AS holm_threshold FROM ranked),
h AS (SELECT *, min(CASE WHEN w_p <= holm_threshold THEN 1 ELSE 0 END) OVER (PARTITION BY study ORDER BY rk) = 1 AS holm_reject FROM thr)
"""
)


def _tested(spark, folder):
    pairs = cut_lineage(study.pairs_of(_cube(spark, folder)))  # effects, ranks and their ties all read the pairs
    return study.pair_tests(pairs, tost_margin=0.5)


@STUDIES.add(
    "pair_wilcoxon",
    _WILCOXON
    + """SELECT study, a, b, n, round(w_p, 9) AS w_p, round(t_p, 6) AS t_p, round(tost_p, 6) AS tost_p, round(CASE WHEN n >= 3 THEN median_diff END, 6) AS median_diff, round(CASE WHEN n >= 3 THEN mean_diff END, 9) AS mean_diff,
  CASE WHEN n < 3 THEN 'only ' || n || ' shared seed(s) -- too few to test' WHEN all_zero THEN 'identical on every seed' END AS note FROM judged""",
)
def pair_wilcoxon(spark, folder):
    tested = _rounded(_rounded(_tested(spark, folder), "w_p", "mean_diff", digits=9), "t_p", "tost_p", "median_diff")
    return tested.select("study", "a", "b", "n", "w_p", "t_p", "tost_p", "median_diff", "mean_diff", "note")


@STUDIES.add("holm_adjust", _WILCOXON + "SELECT study, a, b, round(w_p, 9) AS w_p, round(holm_threshold, 9) AS holm_threshold, holm_reject FROM h")
def holm_adjust(spark, folder):
    return _rounded(study.holm(_tested(spark, folder)).filter("w_p is not null").select("study", "a", "b", "w_p", "holm_threshold", "holm_reject"), "w_p", "holm_threshold", digits=9)


@STUDIES.add(
    "verdicts",
    _WILCOXON
    + """SELECT j.study, j.a, j.b, j.n, CASE WHEN j.n >= 3 THEN CASE WHEN mean_diff < 0 THEN j.a ELSE j.b END END AS winner, round(j.w_p, 9) AS w_p,
  CASE WHEN j.w_p IS NULL THEN 'too few seeds' WHEN holm_reject THEN 'significant' WHEN tost_p <= 0.05 THEN 'equivalent' ELSE 'inconclusive' END AS verdict FROM judged j LEFT JOIN h USING (study, a, b)""",
)
def verdicts(spark, folder):
    judged = study.verdicts(study.holm(_tested(spark, folder)))
    return _rounded(judged.select("study", "a", "b", "n", "winner", "w_p", "verdict"), "w_p", digits=9)


@STUDIES.add("p_formats", _WILCOXON + "SELECT study, a, b, CASE WHEN w_p IS NULL THEN '  n/a ' WHEN w_p >= 0.0001 THEN printf('%.4f', w_p) ELSE printf('%.1e', w_p) END AS p FROM judged")
def p_formats(spark, folder):
    return _tested(spark, folder).select("study", "a", "b", study.format_p(F.col("w_p")).alias("p"))


@STUDIES.add(
    "default_battery",
    _RUNS
    + """
, means AS (SELECT study, config, avg(mape) AS m FROM cube GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY m, config) AS place, list_position(['big_baseline', 'linear', 'naive.last'], config) AS base FROM means),
own AS (SELECT study, arg_min(config, place) AS a FROM pl WHERE base IS NULL GROUP BY 1),
al AS (SELECT x.study, x.config AS a, y.config AS b, 1 AS ord FROM pl x JOIN pl y ON x.study = y.study AND x.place = 1 AND y.place = 2
  UNION ALL SELECT own.study, own.a, p.config, p.base + 1 FROM own JOIN pl p ON p.study = own.study AND p.base IS NOT NULL)
SELECT study, a, b, min(ord)::INT AS ord FROM al GROUP BY ALL
""",
)
def default_battery(spark, folder):
    return study.default_battery(_cube(spark, folder), BASELINES)


# --- Claims ------------------------------------------------------------------------------------


def _claims_sql(steps: list[tuple[str, str]], start: str) -> str:
    """Claims of every document in SQL that has no look-around: marks are put before and after each number.

    A last group of more than three digits is parted from what is before, as it can't end a number.
    """
    clean = start
    for pattern, by in steps:
        clean = f"regexp_replace({clean}, '{pattern}', '{by}', 'g')"
    return rf"""
WITH b1 AS (SELECT doc_id, {clean} AS clean FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents) WHERE t IS NOT NULL),
mk AS (SELECT doc_id, clean, regexp_replace(regexp_replace(clean, ',(\d{{4,}})', chr(3) || ',\1', 'g'), '(^|[^\p{{L}}\p{{N}}_.])(\d{{1,3}}(?:,\d{{3}})+|\d+\.\d+)', '\1' || chr(1) || '\2' || chr(2), 'g') AS m FROM b1),
pt AS (SELECT doc_id, clean, list_transform(str_split(m, chr(1)), lambda p: replace(p, chr(3), '')) AS ps FROM mk),
ps AS (SELECT doc_id, clean, ps, list_transform(ps, lambda p: length(replace(p, chr(2), ''))) AS ls, unnest(range(1, len(ps))) AS pos FROM pt),
claims AS (SELECT doc_id, (pos - 1)::INT AS pos, str_split(ps[pos + 1], chr(2))[1] AS tok, replace(str_split(ps[pos + 1], chr(2))[1], ',', '')::DOUBLE AS val, list_sum(ls[1:pos])::BIGINT AS beg, clean FROM ps)
"""


_MARKDOWN = [(r"\A---\n(?s:.*?)\n---\n", ""), ("(?s)```.*?```", " "), ("(?s)<!--.*?-->", " "), (r"`[^`\n]*`", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\]\([^)]+\)", "]"), (r"\[@[^\]]+\]", " ")]
_TEX = [
    (r"(^|[^\\])%[^\n]*", r"\1"),
    *[(r"\\" + c + r"(\[[^\]]*\])?\{[^}]*\}", " ") for c in "input includegraphics incfig cite ref eqref cref Cref autoref label url usepackage include bibliography resizebox setlength".split()],
    (r"\\pend(\[[^\]]*\])?", " "), (r"\\href\{[^}]*\}", " "), (r"[\d.]+\\(?:text|line|column|page)(?:width|height)", " "), (r"[\d.]+\s*(?:pt|cm|mm|em|ex|in|bp|sp)\b", " "), (r"\{,\}", ","),
]
_TEX_BODY_SQL = r"CASE WHEN regexp_matches(t, '(?s)\\begin\{document\}.*\\end\{document\}') THEN regexp_extract(t, '(?s)\\begin\{document\}(.*)\\end\{document\}', 1) ELSE t END"
_CLAIMS = _claims_sql(_MARKDOWN, "t")


@STUDIES.add("claims_extract", _CLAIMS + "SELECT doc_id, pos, tok, val FROM claims")
def claims_extract(spark, folder):
    """Every document read as Markdown."""
    return claims.extract(claims.scrub(table(spark, folder, "documents")))


@STUDIES.add("claims_extract_tex", _claims_sql(_TEX, _TEX_BODY_SQL) + "SELECT doc_id, pos, tok, val FROM claims")
def claims_extract_tex(spark, folder):
    """Every document read as LaTeX."""
    return claims.extract(claims.scrub(table(spark, folder, "documents").withColumn("path", F.lit("main.tex")), "path"))


@STUDIES.add("claims_contexts", _CLAIMS + r"SELECT doc_id, pos, tok, trim(regexp_replace(substr(clean, greatest(1, beg - 54), beg + length(tok) + 56 - greatest(1, beg - 54)), '[\s\x0b\x85\p{Z}]+', ' ', 'g')) AS ctx FROM claims")
def claims_contexts(spark, folder):
    return claims.contexts(claims.scrub(table(spark, folder, "documents")))


@STUDIES.add(
    "tex_marks",
    r"""WITH m AS (SELECT s_suppkey, s_name AS n FROM supplier)
SELECT s_suppkey, ['a_' || n, 'b.pdf', 'pic.png', n] AS figures, ['9.' || s_suppkey, '??.??', '??.??'] AS pending FROM m""",
)
def tex_marks(spark, folder):
    """Figures and pending marks of a made manuscript of each supplier."""
    made = F.concat(
        F.lit("\\incfig[width=3cm]{ a_"), "s_name", F.lit("} \\includegraphics{b.pdf} \\pend[9."), F.col("s_suppkey").cast("string"), F.lit("] and \\pend, \\pend[] ![x](pic.png \"t\") ![y]("), F.regexp_replace("s_name", r"\s", ""), F.lit(")"),
    )
    return table(spark, folder, "supplier").select("s_suppkey", text.figures(made).alias("figures"), text.pending(made).alias("pending"))


@STUDIES.add(
    "figure_states",
    "SELECT 'f' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.PDF' ELSE '' END AS figure, CASE WHEN p_partkey % 5 = 0 THEN 'N/A' WHEN p_partkey % 5 = 1 THEN 'MISSING' WHEN p_size < 25 THEN 'STALE' ELSE 'fresh' END AS state FROM part",
)
def figure_states(spark, folder):
    """Parts as figures: drawn ones, lost ones, and others dated by size."""
    own = table(spark, folder, "part")
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    kept = own.filter("p_partkey % 5 <> 1").select(F.concat(name, F.when(F.col("p_partkey") % 5 == 0, ".tex").otherwise(".pdf")).alias("path"), F.col("p_size").alias("modified"))
    return claims.figure_staleness(own.select(F.concat(name, F.when(F.col("p_partkey") % 2 == 0, ".PDF").otherwise("")).alias("figure")), kept, F.lit(25))


_TRUTHS = (
    _RUNS
    + """
, firsts AS (SELECT study, seed, min(coalesce(path, '')) AS fp FROM named WHERE NOT coalesce(smoke_test, false) GROUP BY ALL),
ent AS (SELECT n.study, n.seed, f.fp, unnest(map_entries(n.results)) AS e, unnest(range(len(map_entries(n.results)))) AS pl FROM newest n JOIN firsts f ON n.study = f.study AND n.seed IS NOT DISTINCT FROM f.seed),
vals AS (SELECT study, seed, fp, pl, e.key AS config, unnest([{'m': 'mape', 'x': e.value.mape::DOUBLE, 'o': 0}, {'m': 'rmse', 'x': e.value.rmse::DOUBLE, 'o': 1}, {'m': 'mae', 'x': e.value.mae::DOUBLE, 'o': 2}, {'m': 'params', 'x': e.value.params::DOUBLE, 'o': 3}]) AS v FROM ent),
good AS (SELECT study, config, v.m AS metric, v.x AS x, fp, pl, seed, v.o AS o FROM vals WHERE v.x IS NOT NULL AND NOT isnan(v.x)),
agg AS (SELECT study || ':' || config || ':' || metric AS src, metric, avg(x) AS mean, count(*) AS n, stddev_samp(x) AS sd, arg_min(x, (fp, pl * 4 + o, seed)) AS first FROM good GROUP BY study, config, metric)
"""
)


def _pool_runs(spark, folder):
    return study.supersede(_named(spark, folder), seen="first_path")


@STUDIES.add("truth_pool", _TRUTHS + "SELECT src, count(*) + (1 + (n > 1)::INT + (metric = 'params')::INT) AS entries, first(round(mean, 9)) AS mean, first(round(CASE WHEN n > 1 THEN sd END, 6)) AS sd, first(CASE WHEN metric = 'params' THEN first END) AS params FROM agg GROUP BY src, n, metric")
def truth_pool(spark, folder):
    """What each source of the pool holds: its number of entries, and the values that they were rounded from."""
    pool = claims.pool_from_results(_pool_runs(spark, folder))
    held = pool.groupBy("src").agg(F.count(F.lit(1)).alias("entries"), F.max(F.when(F.col("ord.at") == 3, F.col("value"))).alias("params"))
    return held.join(claims.result_measures(_pool_runs(spark, folder)).select("src", F.round("mean", 9).alias("mean"), F.round(F.when(F.col("n") > 1, F.col("sd")), 6).alias("sd")), "src")


def _tables_sql() -> str:
    """Numbers of the table fragments among the documents."""
    return r"""tk AS (SELECT doc_id, regexp_extract_all(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '{,}', ','), ',(\d{4,})', chr(3) || ',\1', 'g'), '(?:^|[^\p{L}\p{N}_.])(\d{1,3}(?:,\d{3})+|\d+\.\d+)', 1) AS l FROM documents WHERE source = 'table_fragment' AND text IS NOT NULL),
fr AS (SELECT doc_id, unnest(l) AS tok FROM tk)"""


@STUDIES.add("pool_from_tables", "WITH " + _tables_sql() + " SELECT 'd' || doc_id || '.tex' AS src, replace(tok, ',', '')::DOUBLE AS value, count(*) AS times FROM fr GROUP BY ALL")
def pool_from_tables(spark, folder):
    return _tables_pool(spark, folder).groupBy("src", "value").agg(F.count(F.lit(1)).alias("times"))


def _tables_pool(spark, folder):
    fragments = table(spark, folder, "documents").filter(F.col("source") == "table_fragment")
    return claims.pool_from_tables(fragments.select(F.concat(F.lit("tables/d"), F.col("doc_id").cast("string"), F.lit(".tex")).alias("path"), "text"))


def _audited_claims(spark, folder):
    pool = claims.union_pools(_tables_pool(spark, folder), claims.pool_from_results(_pool_runs(spark, folder)))
    own = table(spark, folder, "documents").filter(~F.col("source").eqNullSafe("table_fragment"))
    manuscripts = own.withColumn("path", F.when(F.col("source").isin("manuscript", "thesis", "lecture_notes"), "main.tex").otherwise("text.md"))
    return claims.classify(claims.contexts(claims.scrub(manuscripts, "path")).withColumn("val", text.as_number(F.col("tok"))), pool)


@STUDIES.add("claims_audit")
def claims_audit(spark, folder):
    """The claims of all documents but the table fragments against the fragments and the stored results.

    The means that the pool rounds are rounded half to even on the exact binary value, which SQL can't say.
    """
    return _audited_claims(spark, folder)


@STUDIES.add("claims_audit_buckets")
def claims_audit_buckets(spark, folder):
    return claims.buckets(_audited_claims(spark, folder))


_NEAREST = """
WITH c AS (SELECT o_orderkey, o_totalprice / 100 AS val FROM orders),
p AS (SELECT p_retailprice AS value, arg_min(p_name, p_partkey) AS src, min(p_partkey) AS ord FROM part GROUP BY 1),
lo AS (SELECT c.*, p.value AS lv, p.src AS ls, p.ord AS lo FROM c ASOF LEFT JOIN p ON c.val >= p.value),
hi AS (SELECT lo.*, p.value AS hv, p.src AS hs, p.ord AS ho FROM lo ASOF LEFT JOIN p ON lo.val <= p.value),
n AS (SELECT o_orderkey, val, hv IS NULL OR (lv IS NOT NULL AND (abs(val - lv) < abs(val - hv) OR (abs(val - lv) = abs(val - hv) AND lo <= ho))) AS low, lv, ls, hv, hs FROM hi),
b AS (SELECT o_orderkey, val, CASE WHEN low THEN lv ELSE hv END AS best, CASE WHEN low THEN ls ELSE hs END AS src FROM n),
k AS (SELECT *, CASE WHEN val < 100 THEN CASE WHEN abs(val - best) <= 0.005::DOUBLE THEN 'MATCHED' WHEN abs(val - best) <= 0.1::DOUBLE THEN 'NEAR-MISS' ELSE 'ORPHAN' END
  WHEN abs(val - best) < 0.5 OR abs(val - best) / greatest(val, 1.0) < 0.003::DOUBLE THEN 'MATCHED' WHEN abs(val - best) / greatest(val, 1.0) < 0.05::DOUBLE THEN 'NEAR-MISS' ELSE 'ORPHAN' END AS bucket FROM b)
"""


def _price_claims(spark, folder):
    own = table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("val"))
    pool = table(spark, folder, "part").select(F.col("p_retailprice").alias("value"), F.col("p_name").alias("src"), F.col("p_partkey").alias("ord"))
    return own, pool


@STUDIES.add("claims_classify", _NEAREST + "SELECT o_orderkey, val, best, src, bucket, val BETWEEN 0.3 AND 15 AS mape_like FROM k")
def claims_classify(spark, folder):
    return claims.classify(*_price_claims(spark, folder))


@STUDIES.add("claims_nearest_ranges", _NEAREST + "SELECT o_orderkey, val, best, src FROM k")
def claims_nearest_ranges(spark, folder):
    """The join for pools of any size, which the size check keeps from small ones."""
    own, pool = _price_claims(spark, folder)
    return claims._nearest_by_ranges(own, claims.ordered_pool(pool), "val")


@STUDIES.add("claims_buckets", _NEAREST + "SELECT bucket, count(*) AS claims FROM k GROUP BY 1")
def claims_buckets(spark, folder):
    return claims.buckets(claims.classify(*_price_claims(spark, folder)))


# --- Run integrity -----------------------------------------------------------------------------

_KEY = "coalesce(nullif(notebook, ''), '?') || '::' || coalesce(span_start, '')"


@STUDIES.add(
    "run_findings",
    """
WITH x AS (SELECT *, coalesce(map_entries(results), []) AS es FROM results),
f AS (SELECT run_id, smoke_test, list_filter(['small_A', 'small_B', 'big_baseline', 'MTGNN'], lambda c: NOT list_contains(list_transform(es, lambda e: e.key), c)) AS missing,
  flatten(list_transform(es, lambda e: list_filter([CASE WHEN e.value.mape IS NULL OR NOT isfinite(e.value.mape) THEN e.key || '.mape' END, CASE WHEN e.value.rmse IS NULL OR NOT isfinite(e.value.rmse) THEN e.key || '.rmse' END,
    CASE WHEN e.value.mae IS NULL OR NOT isfinite(e.value.mae) THEN e.key || '.mae' END], lambda b: b IS NOT NULL))) AS bad,
  list_transform(list_filter(es, lambda e: coalesce(e.value.futility_stop, '') <> ''), lambda e: e.key || ': ' || e.value.futility_stop) AS futility,
  list_filter(['small_A', 'small_B'], lambda k: len(list_filter(es, lambda e: e.key = k AND e.value.params IS DISTINCT FROM CASE k WHEN 'small_A' THEN 12000 ELSE 18131 END)) > 0) AS off_anchor FROM x)
SELECT run_id, missing, bad, futility, off_anchor,
  CASE WHEN len(missing) > 0 OR len(bad) > 0 OR len(off_anchor) > 0 THEN 'FAIL' WHEN coalesce(smoke_test, false) OR len(futility) > 0 THEN 'DISCLOSE' ELSE 'OK' END AS tag FROM f
""",
)
def run_findings(spark, folder):
    return integrity.findings(table(spark, folder, "results"), EXPECT, ANCHORS).select("run_id", "missing", "bad", "futility", "off_anchor", "tag")


@STUDIES.add("seed_census", f"WITH s AS (SELECT {_KEY} AS study, CASE WHEN NOT coalesce(smoke_test, false) THEN seed END AS seed FROM results) SELECT study, coalesce(list_sort(list(DISTINCT seed) FILTER (WHERE seed IS NOT NULL)), []) AS seeds, count(DISTINCT seed)::INT AS n, count(*) AS runs, count(DISTINCT seed) > 1 AS robust FROM s GROUP BY 1")
def seed_census(spark, folder):
    return integrity.seed_census(table(spark, folder, "results"))


@STUDIES.add("config_seeds", f"WITH c AS (SELECT DISTINCT {_KEY} AS study, coalesce(seed, -987654321) AS seed, unnest(map_keys(results)) AS config FROM results WHERE NOT coalesce(smoke_test, false)) SELECT study, config, count(*) AS seeds FROM c GROUP BY ALL")
def config_seeds(spark, folder):
    return integrity.config_seeds(table(spark, folder, "results"))


@STUDIES.add(
    "under_coverage",
    f"""
WITH x AS (SELECT {_KEY} AS study, seed, coalesce(map_keys(results), []) AS ks FROM results WHERE NOT coalesce(smoke_test, false)),
c AS (SELECT unnest(['small_A', 'small_B', 'big_baseline', 'MTGNN']) AS config),
g AS (SELECT study, config, count(DISTINCT seed) AS study_seeds, count(DISTINCT CASE WHEN list_contains(ks, config) THEN seed END) + max(CASE WHEN list_contains(ks, config) AND seed IS NULL THEN 1 ELSE 0 END) AS seeds FROM x, c GROUP BY ALL)
SELECT study, config, seeds, study_seeds FROM g WHERE seeds < study_seeds
""",
)
def under_coverage(spark, folder):
    return integrity.under_coverage(table(spark, folder, "results"), EXPECT)


@STUDIES.add("landed_findings")
def landed_findings(spark, folder):
    """Findings over the raw result files as they landed; unreadable ones fail. Shapes drift, so much is missing there."""
    landed = files.parse_runs(table(spark, folder, "run_files").select(F.col("file_id").alias("run_id"), F.col("body").alias("value")))
    return integrity.findings(landed, EXPECT, ANCHORS).select("run_id", "missing", "bad", "futility", "off_anchor", "tag")


# --- Profiles ----------------------------------------------------------------------------------


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    """``columns``: text, number or other, by name."""
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        missing = f"({c} IS NULL OR lower(trim({c})) IN ('', 'na', 'nan', 'null', 'none', 'n/a'))" if kind == "text" else f"{c} IS NULL"
        number = f"{c}::DOUBLE" if kind == "number" else f"CASE WHEN regexp_full_match(trim({c}), '[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?|[+-]?(?i:inf|infinity)') THEN try_cast(trim({c}) AS DOUBLE) END" if kind == "text" else "NULL::DOUBLE"
        held = f"trim({c})" if kind == "text" else c
        distinct = f"count(DISTINCT {held}) FILTER (WHERE NOT {missing})"
        parts.append(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE {missing}) AS nulls, CASE WHEN {distinct} <= 1000 THEN ({distinct})::INT END AS \"distinct\", min({number}) AS min, max({number}) AS max FROM {name}")
    return " UNION ALL ".join(parts)


def _profile(spark, folder, name, *columns):
    return profile.profile(table(spark, folder, name).select(*columns)).drop("place", "col_hash")


for _name, _columns in {
    "customer": {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"},
    "documents": {"doc_id": "number", "text": "text", "lang": "text", "source": "text", "n_chars": "number", "notebook": "text"},
    "bib_records": {"bib_id": "number", "citekey": "text", "src": "text", "title": "text", "year": "number", "venue": "text", "doi": "text", "arxiv": "text"},
    "results": {"run_id": "number", "path": "text", "notebook": "text", "seed": "number", "span_start": "text", "timestamp_utc": "text"},
}.items():
    STUDIES.add(f"profile_{_name}", _profile_sql(_name, _columns))(lambda spark, folder, _n=_name, _c=tuple(_columns): _profile(spark, folder, _n, *_c))


@STUDIES.add("column_hashes")
def column_hashes(spark, folder):
    """Order-sensitive hashes of the columns of the customers, by their key."""
    return profile.profile(table(spark, folder, "customer"), "c_custkey").select("column", "col_hash")


def _altered(spark, folder):
    own = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return own, own.select("c_custkey", "c_name", F.lit(1.5).alias("c_acctbal"), F.col("c_name").alias("again"), F.lit(None).cast("string").alias("nothing"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("thin"))


@STUDIES.add("degeneracies", "SELECT * FROM (VALUES ('c_acctbal', 'CONSTANT'), ('again', 'DUPLICATES c_name'), ('nothing', 'ALL-NULL'), ('thin', '>50% NULL')) t(\"column\", problem)")
def degeneracies(spark, folder):
    return profile.degeneracies(profile.profile(_altered(spark, folder)[1], "c_custkey"))


@STUDIES.add("drift", "SELECT * FROM (VALUES ('c_acctbal', 'hard', 'collapsed to a constant'), ('c_acctbal', 'soft', 'content changed'), ('again', 'hard', 'column added'), ('nothing', 'hard', 'column added'), ('thin', 'hard', 'column added')) t(\"column\", severity, change)")
def drift_between(spark, folder):
    before, after = _altered(spark, folder)
    return profile.drift(profile.profile(before, "c_custkey"), profile.profile(after, "c_custkey"))


@STUDIES.add(
    "verify_files",
    """SELECT * FROM (VALUES ('gone', 'FAIL', 'missing'), ('new', 'warn', 'new file'), ('b', 'FAIL', 'c_acctbal: collapsed to a constant'), ('b', 'warn', 'c_acctbal: content changed'), ('b', 'FAIL', 'again: column added'), ('b', 'FAIL', 'nothing: column added'),
  ('b', 'FAIL', 'thin: column added'), ('b', 'FAIL', 'c_acctbal: CONSTANT'), ('b', 'FAIL', 'again: DUPLICATES c_name'), ('b', 'FAIL', 'nothing: ALL-NULL'), ('b', 'FAIL', 'thin: >50% NULL')) t(file, severity, why)""",
)
def verify_files(spark, folder):
    """Profiles of four files before and after: one as it was, one altered, one gone, one new."""
    before, after = (profile.profile(d, "c_custkey") for d in _altered(spark, folder))
    named = lambda d, name, mark: d.withColumns({"file": F.lit(name), "sha256": F.lit(mark)})
    old = named(before, "a", "1").unionByName(named(before, "b", "2")).unionByName(named(before, "gone", "3"))
    return profile.verify(old, named(before, "a", "1").unionByName(named(after, "b", "4")).unionByName(named(before, "new", "3")))


@STUDIES.add("array_profile", "SELECT count(*) AS rows, max(len(embedding))::INT AS width, sum(len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))))::BIGINT AS nans, min(list_min(embedding))::DOUBLE AS min, max(list_max(embedding))::DOUBLE AS max, min(list_min(embedding)) = max(list_max(embedding)) AS constant FROM embeddings")
def array_profile(spark, folder):
    return profile.array_profile(table(spark, folder, "embeddings"), "embedding")
