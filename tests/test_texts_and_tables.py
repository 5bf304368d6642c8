"""Claims, integrity, profiles, bibliography, store, log, reviews, gate, sweeps, sources, streams."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from attestra.functions import stats, text
from attestra.operators import biblio, claims, gate, integrity, log, profile, review, store, sweep
from attestra.plans.studies import STUDIES
from attestra.sources import bibtex, files
from attestra.streaming import landing


def test_claims_of_noise(spark):
    tex = r"\begin{document}\cite{a2001} \ref{f:1.5} \input{x3.5} \includegraphics[width=0.5\textwidth]{f1.25} 12pt \pend[9.99] \pend a 3.46 and 18{,}442 but 2024, é7.7 1.2.3 % 8.88" + "\n" + r"\end{document}"
    rows = spark.createDataFrame([(1, "a.tex", tex), (2, "b.md", "---\nv: 1.5\n---\n`2.5` ![f 9.9](x4.5.png) [a](u7.5) [@k2.0] keep 3.56 and 3.48\n```\n6.66\n```"), (3, "c.md", None), (4, "d.md", "")], "doc_id bigint, path string, text string")
    got = claims.extract(claims.scrub(rows, "path")).collect()
    assert [(r.doc_id, r.tok) for r in sorted(got, key=lambda r: (r.doc_id, r.pos))] == [(1, "3.46"), (1, "18,442"), (1, "1.2"), (2, "3.56"), (2, "3.48")] and {r.val for r in got} >= {18442.0, 3.46}
    ctx = {(r.doc_id, r.tok): r.ctx for r in claims.contexts(claims.scrub(rows, "path")).collect()}
    assert "3.46" in ctx[1, "3.46"]
    one = rows.filter("doc_id = 1").select(text.figures(F.col("text")).alias("f"), text.pending(F.col("text")).alias("p")).first()
    assert one.f == ["f1.25"] and one.p == ["9.99", "??.??"]


def test_buckets(spark):
    pool = spark.createDataFrame([(3.46, "tab", 1), (45393.0, "res", 2), (3.46, "later", 3), (float("nan"), "bad", 4)], "value double, src string, ord bigint")
    rows = spark.createDataFrame([(3.465,), (3.53,), (45000.0,), (99.0,), (45393.4,), (None,)], "val double")
    got = {r.val: (r.bucket, r.src) for r in claims.classify(rows, pool).collect()}
    assert got[3.465] == ("MATCHED", "tab") and got[3.53] == ("NEAR-MISS", "tab") and got[45000.0] == ("NEAR-MISS", "res") and got[99.0] == ("ORPHAN", "tab") and got[45393.4] == ("MATCHED", "res")
    none = claims.classify(rows, pool.limit(0)).collect()
    assert {r.bucket for r in none} == {"ORPHAN"}
    ties = claims.classify(spark.createDataFrame([(2.0,)], "val double"), spark.createDataFrame([(3.0, "first", 1), (1.0, "second", 2)], "value double, src string, ord bigint")).first()
    assert ties.src == "first"


def test_both_nearest_joins_agree(spark):
    pool = spark.range(400).select((F.col("id") * F.col("id") / 7).alias("value"), F.concat(F.lit("p"), "id").alias("src"), F.col("id").alias("ord"))
    rows = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") == 7, float("nan")).when(F.col("id") != 8, F.col("id") * 47.3 - 100).alias("val"))
    rows = rows.unionByName(spark.range(500, 900).select(F.col("id").alias("k"), F.lit(3.5).alias("val")))
    own = claims.ordered_pool(pool)
    a = {(r.k, r.best, r.src) for r in claims._nearest_in_array(rows, own.collect(), "val").collect()}
    assert len(a) == 900 and {(7, None, None), (8, None, None)} <= a
    assert a == {(r.k, r.best, r.src) for r in claims._nearest_by_ranges(rows, own, "val").collect()}


def test_rounding_is_that_of_the_exact_value(spark):
    got = [r[0] for r in spark.createDataFrame([(2.675,), (0.125,), (None,)], "v double").select(stats.half_even("v", F.lit(2))).collect()]
    assert got == [2.67, 0.12, None]


RUNS = "run_id bigint, notebook string, span_start string, seed bigint, smoke_test boolean, results map<string,struct<rmse:double,mae:double,mape:double,params:bigint,futility_stop:string>>"


def test_run_findings(spark):
    good, nan = (1.0, 1.0, 1.0, 999, None), (1.0, 1.0, float("nan"), 45393, "plateau")
    rows = [(1, "n", None, 1, False, {"A": good, "B": good}), (2, "n", None, 2, False, {"A": nan}), (3, "n", None, 3, True, {"A": good, "B": good}), (4, None, "s", None, None, None)]
    got = {r.run_id: r for r in integrity.findings(spark.createDataFrame(rows, RUNS), ["A", "B"], {"A": 999}).collect()}
    assert got[1].tag == "OK" and got[2].tag == "FAIL" and got[2].missing == ["B"] and got[2].bad == ["A.mape"] and got[2].off_anchor == ["A"] and got[3].tag == "DISCLOSE" and got[4].missing == ["A", "B"]
    table = spark.createDataFrame(rows, RUNS)
    assert {(r.study, tuple(r.seeds)) for r in integrity.seed_census(table).collect()} == {("n::", (1, 2)), ("?::s", ())}
    assert {(r.config, r.seeds) for r in integrity.under_coverage(table, ["A", "B"]).collect()} == {("B", 1)}
    assert integrity.any_failure(integrity.findings(table, ["A"], {})) and integrity.parse_anchors("A=1, B=-2") == {"A": 1, "B": -2}
    with pytest.raises(ValueError):
        integrity.parse_anchors("A")


def test_profile_and_drift(spark):
    rows = spark.createDataFrame([("1", "x", None, "1"), ("2.5", "x", "NA", "2.5"), (" ", "x", "", " "), ("inf", "x", "null", "inf")], "a string, b string, c string, d string")
    got = {r.column: r for r in profile.profile(rows).collect()}
    assert (got["a"].nulls, got["a"].distinct, got["a"].min, got["a"].max) == (1, 3, 1.0, float("inf")) and got["c"].nulls == 4
    assert {(r.column, r.problem) for r in profile.degeneracies(profile.profile(rows)).collect()} == {("b", "CONSTANT"), ("c", "ALL-NULL"), ("d", "DUPLICATES a")}
    changes = {(r.column, r.change) for r in profile.drift(profile.profile(rows), profile.profile(rows.withColumn("a", F.lit("1")).drop("d"))).collect()}
    assert ("a", "collapsed to a constant") in changes and ("d", "column gone") in changes
    assert profile.drift(profile.profile(rows), profile.profile(rows)).count() == 0
    assert {r.nulls for r in profile.profile(rows.limit(0)).collect()} == {0}
    numbered = spark.createDataFrame([(i, v, w, v) for i, (v, w) in enumerate(zip("abca", "acba"))], "line int, x string, y string, z string")
    marks = lambda d: {r.column: r.col_hash for r in profile.profile(d, "line").collect()}
    own = marks(numbered)
    assert own["x"] == own["z"] != own["y"] and marks(numbered.orderBy(F.desc("line"))) == own and marks(numbered.withColumn("line", 3 - F.col("line")))["x"] != own["x"]


BIB = '@comment{x}\n@article{k1, title = {A {B} c}, Year = 1999, author = "X and {Y}", title = {Last {one}}}\n@string{s = "v"}\n@misc{k2,\n howpublished = {\\url{http://a.b}}}'


def test_bibtex(spark):
    got = bibtex.entries(BIB)
    assert [(k, c) for k, c, _ in got] == [("article", "k1"), ("misc", "k2")] and got[0][2] == {"title": "Last {one}", "year": "1999", "author": "X and {Y}"}
    rows = bibtex.parse(spark.createDataFrame([("p", BIB), ("q", None), ("r", "")], "path string, text string"))
    assert rows.count() == 2 and rows.filter("citekey = 'k2'").select(biblio.url_of(F.col("fields"))).first()[0] == "http://a.b"


def test_audit(spark):
    entries = spark.createDataFrame(
        [(1, "Deep nets", 2000, None, "https://doi.org/10.1/A."), (2, "Deep nets", 2001, None, None), (3, "Deep nets", 1950, None, "10.1/a"), (4, None, None, None, None), (5, "Nothing like it at all", 2000, None, None), (6, "Deep nets", 2000, None, "10.9/r")],
        "entry int, title string, year int, venue string, doi string",
    )
    records = spark.createDataFrame([("p", 1, "Deep Nets", 2000, None, "10.1/a", False), ("q", 2, "Old nets", 1990, None, "10.9/r", True)], "record string, ord int, title string, year int, venue string, doi string, retracted boolean")
    got = {r.entry: r for r in biblio.audit(entries, records).collect()}
    assert [got[i].verdict for i in range(1, 7)] == ["VERIFIED", "VERIFIED", "MISMATCH", "UNVERIFIABLE", "NOT-FOUND", "RETRACTED"]
    assert got[2].notes == ["year differs by 1 (2001 vs 2000)"] and got[2].diffs == ["doi"] and got[3].diffs == ["year"] and got[3].suggest == ["year = {2000}"]
    other = records.withColumn("retracted", F.lit(True))
    late = spark.createDataFrame([(1, "Deep nets", 2009, None, None), (2, "Deep nests of", 2000, None, None), (3, "Deep nets", 2000, None, "10.7/none")], "entry int, title string, year int, venue string, doi string")
    # A like title alone is not the same work, so the record's retraction says nothing about the entry.
    assert {r.entry: r.verdict for r in biblio.audit(late, other).collect()} == {1: "MISMATCH", 2: "MISMATCH", 3: "NOT-FOUND"}
    assert biblio.ORDER[:3] == ("RETRACTED", "MISMATCH", "NOT-FOUND")
    assert {r.verdict: r.severity for r in biblio.verdict_counts(biblio.audit(entries, records)).collect()}["RETRACTED"] == 1


def test_citations(spark):
    docs = spark.createDataFrame([(1, "We use \\citep[p. 2]{a, b}. Next one.\n\nNew \\cite{c}! % \\cite{no}\n"), (2, None)], "doc_id bigint, text string")
    cited = biblio.cited_sentences(docs)
    assert {(r.sentence, r.cited) for r in cited.collect()} == {("We use [CITE].", "a"), ("We use [CITE].", "b"), ("New [CITE]!", "c")}
    bib = spark.createDataFrame([("a", "Deep nets", "10.1/a", 1), ("b", "Shallow nets of old", None, 2)], "citekey string, title string, doi string, ord int")
    papers = spark.createDataFrame([("p", "x", "10.1/A", 1, "text", "abstract"), ("q", "Shallow nets, of old", None, 2, None, None)], "paperid string, title string, doi string, ord int, abstract_text string, abstract_src string")
    assert {(r.cited, r.status, r.matched_by) for r in biblio.pair_citations(cited, bib, papers).collect()} == {("a", "PAIRED", "doi"), ("b", "NO-ABSTRACT", "title"), ("c", "NO-BIB-ENTRY", None)}


def test_claims_are_shown_in_context(spark, small):
    docs = {r.doc_id: r.clean for r in claims.scrub(spark.read.parquet(f"{small}/documents.parquet")).select("doc_id", "clean").collect()}
    rows = STUDIES.queries["claims_contexts"](spark, small).collect()
    assert len(rows) == STUDIES.queries["claims_extract"](spark, small).count() > 0
    at = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.pos)):
        body = docs[r.doc_id]
        start = body.index(r.tok, at.get(r.doc_id, 0))
        while " ".join(body[max(0, start - 55) : start + len(r.tok) + 55].split()) != r.ctx:
            start = body.index(r.tok, start + 1)
        at[r.doc_id] = start + len(r.tok)


def test_titles_are_compared_with_all_papers(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeinorst", k=rng.randint(3, 9))) for _ in range(30)]
    titles = list(dict.fromkeys(" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(300))) + ["ab", "x" * 230]
    bent = lambda t: "".join(rng.choice("aeiou ") if rng.random() < 0.09 else c for c in t).strip() or "a"
    asked = list(dict.fromkeys([bent(t) for t in titles[:150]] + titles[150:200] + ["ab", "x" * 230, "x" * 229 + "y"]))
    papers = spark.createDataFrame([(f"p{i}", i, t) for i, t in enumerate(titles + titles[:20])], "record string, ord int, rt string")
    entries = spark.createDataFrame(list(enumerate(asked)), "entry int, lt string")
    want = {}
    for i, lt in enumerate(asked):
        ratios = [difflib.SequenceMatcher(None, lt, rt).ratio() for rt in titles]
        if max(ratios) >= 0.85:
            want[i] = (f"p{ratios.index(max(ratios))}", max(ratios))
    assert len(want) > 100 and {r.entry: (r.record, r.likeness) for r in biblio.best_title(entries, papers, 0.85, search=False).collect()} == want
    pieces = biblio.alike_titles(entries, papers, 0.85, lengths=3, block=7).groupBy("lt").agg(F.max("likeness").alias("m"))
    assert {r.lt: r.m for r in pieces.collect()} == {asked[i]: r for i, (_, r) in want.items()}


def test_citation_without_a_shared_word(spark):
    cited = spark.createDataFrame([("a",)], "cited string")
    bib = spark.createDataFrame([("a", " Timeseries forcasting baselnes", None, 1)], "citekey string, title string, doi string, ord int")
    near = [(f"n{i}", f"Timeseries {w}", None, i, "text", "abstract") for i, w in enumerate(("a", "b", "c", "d", "e", "f"))]
    papers = spark.createDataFrame([*near, ("q", "Time series forecasting baselines", None, 9, "text", "abstract")], "paperid string, title string, doi string, ord int, abstract_text string, abstract_src string")
    row = biblio.pair_citations(cited, bib, papers).first()
    assert (row.paperid, row.status, row.matched_by) == ("q", "PAIRED", "title")


def test_store(spark):
    rows = spark.createDataFrame([("a", 1, "", None, "search:x"), ("a", 2, "T", 3, "bulk:y"), ("a", 3, "U", 4, "search:x"), (None, 4, "V", 5, "z")], "paperid string, row_id int, title string, year int, source string")
    got = store.merge(rows).collect()
    assert len(got) == 1 and (got[0].title, got[0].year, got[0].sources) == ("T", 3, ["search:x", "bulk:y"])
    assert store.new_keys(rows.filter("row_id = 1").select("paperid"), rows).count() == 0
    papers = spark.createDataFrame([("a", "traffic forecasting", None, "noise"), ("b", "cooking", None, None)], "paperid string, title string, tldr string, abstract string")
    rel = {r.paperid: r for r in store.relevance(papers, "traffic noise for the").collect()}
    assert rel["a"].relevance == 1.0 and rel["b"].relevance == 0.0 and sorted(rel["a"].matched) == ["noise", "traffic"]
    with pytest.raises(ValueError):
        store.relevance(papers, "the of")
    index = spark.sql("select map('hello', array(0, 3), 'world', array(1), 'again', array(2)) m union all select map() union all select null")
    assert [r[0] for r in index.select(store.from_inverted_index(F.col("m"))).collect()] == ["hello world again hello", None, None]
    assert store.from_inverted_index is not None and [r.tier for r in spark.createDataFrame([(0.6,), (0.3,), (0.1,)], "s double").select(store.tier(F.col("s")).alias("tier")).collect()] == ["Core", "Related", "Peripheral"]


LOG = "id bigint, track string, type string, session string, text string, evidence array<string>, refs array<bigint>"


def test_log(spark):
    rows = spark.createDataFrame([(1, "t", "finding", "s1", "x", [], None), (2, "t", "correction", "s1", "y", None, [1, 9]), (3, "u", "next", "s2", "do", None, None), (4, "u", "finding", "s2", "z", ["f"], None)], LOG)
    assert {(r.id, tuple(r.by)) for r in log.superseded(rows).collect()} == {(1, (2,)), (9, (2,))}
    assert {(r.id, r.warning) for r in log.warnings(rows).collect()} == {(1, "finding without evidence"), (2, "unknown ref #9")}
    text_rows = spark.createDataFrame([(1, "see #1 and #55"), (2, "nothing"), (3, "#4 holds")], "doc_id bigint, text string")
    assert {(r.doc_id, r.severity, r.ref) for r in log.check_narrative(text_rows, rows).collect()} == {(1, "FAIL", 55), (1, "warn", 1), (2, "FAIL", None)}
    assert log.uncited_findings(text_rows.limit(0), rows).collect()[0].id == 4
    tracks = spark.createDataFrame([("t", "blocked"), ("v", "paused")], "id string, status string")
    assert {(r.track, r.next_step, r.stale) for r in log.digest(tracks, rows).collect()} == {("t", None, False), ("u", "do", True), ("v", None, False)}
    added = log.append(rows, spark.createDataFrame([(2, "t", "b"), (1, "t", "a")], "ord int, track string, text string"))
    assert {(r.id, r.text) for r in added.collect()} == {(5, "a"), (6, "b")}
    wanted = spark.createDataFrame([("t", "dropped", "why"), ("v", "paused", None)], "track string, status string, note string")
    assert {(r.track, r.type, r.text) for r in log.status_changes(tracks, wanted).collect()} == {("t", "status", "status blocked -> dropped: why"), ("t", "decision", "why")}
    same = spark.createDataFrame([("t", "blocked", None)], wanted.schema)
    assert [(r.type, r.text) for r in log.status_changes(tracks, same).collect()] == [("status", "status blocked -> blocked")]
    meta, registry, entries = log.init(spark, "inv")
    asked = spark.createDataFrame([("a", "A", "b, c", None), ("b", "B", None, "active"), ("x", "X", None, "open")], "id string, title string, depends string, status string")
    registry, problems = log.add_tracks(registry, asked)
    assert {(r.id, r.status, tuple(r.depends_on)) for r in registry.collect()} == {("a", "pending", ("b", "c")), ("b", "active", ())} and meta.count() == 1 and entries.count() == 0
    assert {(r.id, r.problem) for r in problems.collect()} == {("a", "unknown dependency c"), ("x", "no status")}
    assert {(r.id, r.problem) for r in log.add_tracks(registry, asked.limit(1))[1].collect()} == {("a", "exists")}
    changed = log.set_status(registry, spark.createDataFrame([("a", "done"), ("b", "never")], "track string, status string"))
    assert {r.id: r.status for r in changed.collect()} == {"a": "done", "b": "active"}
    paths = spark.createDataFrame([("g",)], "path string")
    assert {(r.id, r.warning) for r in log.warnings(rows, spark.createDataFrame([("t",)], "id string"), paths).collect()} >= {(3, "unknown track u"), (4, "no file f")}


def test_reviews(spark):
    rows = spark.createDataFrame([(1, "Dear authors, thank you.\n1. First comment is here.\n2) Second comment is here.\nC3: Third comment is here."), (2, "One paragraph of text.\n\nAnother paragraph of text."), (3, None), (4, "short")], "doc_id bigint, text string")
    got = review.split_comments(rows).collect()
    assert [sum(r.doc_id == i for r in got) for i in (1, 2, 3, 4)] == [4, 2, 0, 0]
    store_ = review.import_reviews(review.init(spark), rows.select(F.lit("R1").alias("reviewer"), F.col("doc_id").alias("ord"), "text"))
    store_ = review.add(store_, spark.createDataFrame([("R1", 1, "by hand"), ("R2", 2, "other")], "reviewer string, ord int, text string"))
    assert sorted(r.id for r in store_.collect()) == ["R1.1", "R1.2", "R1.3", "R1.4", "R1.5", "R1.6", "R1.7", "R2.1"]
    answers = spark.createDataFrame([("R1.1", "done", None, "a.tex, b.tex", None), ("R1.2", "no", "decline", None, None), ("R9.9", "x", None, None, None), ("R1.3", "y", "other", None, None)], "id string, text string, action string, anchors string, quote string")
    told = {r.id: r for r in review.respond(store_, answers).collect()}
    assert (told["R1.1"].action, told["R1.1"].anchors, told["R1.2"].action, told["R1.3"].response) == ("change", ["a.tex", "b.tex"], "decline", None)
    assert {(r.id, r.problem) for r in review.unknown_answers(store_, answers).collect()} == {("R9.9", "unknown comment"), ("R1.3", "no action")}
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["--- a/x", "+++ b/sub/main.tex", "+new  text", "+more", "-old", "+++ /dev/null", "+++ c d.tex"])], "diff_id int, line_no int, line string")
    changed, added = review.parse_diff(lines)
    assert {r.file for r in changed.collect()} == {"sub/main.tex", "c d.tex"} and added.first().added == "new text more "
    long = spark.createDataFrame([(1, 1, "+" + "x" * 1_200_000 + " end")], "diff_id int, line_no int, line string")
    assert review.parse_diff(long)[1].first().added.endswith(" end ")
    comments = spark.createDataFrame(
        [("a", "r", "change", ["main.tex"], None), ("b", "r", "change", ["other.tex"], None), ("c", "r", "change", None, "text  more"), ("d", "r", "change", None, "absent"), ("e", None, None, None, None), ("f", "r", "clarify", None, None), ("g", "r", "change", [], None), ("h", "r", "change", None, "n")],
        "id string, response string, action string, anchors array<string>, quote string",
    )
    checked = {r.id: r.verdict for r in review.check_responses(comments, changed, added, spark.createDataFrame([("m",), ("n",), (None,)], "text string")).collect()}
    assert checked == {"a": "ok", "b": "FAIL", "c": "ok", "d": "FAIL", "e": "FAIL", "f": "ok", "g": "FAIL", "h": "ok"}


def test_search_is_exact(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "a"] * 6
    titles = list({" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(300)})
    asked = list({" ".join(rng.choices(words + ["new"], k=rng.randint(1, 8))) for _ in range(60)}) + ["the of a", "nothing"]
    df = {w: sum(w in t.split() for t in titles) for t in titles for w in t.split()}
    want = set()
    for a in asked:
        scores = {t: sum((1 << 50) // df[w] ** 2 for w in set(a.split()) & set(t.split())) for t in titles}
        want |= {(a, t) for t in sorted((t for t, s in scores.items() if s > 0), key=lambda t: (-scores[t], t))[:5]}
    left, right = spark.createDataFrame([(a,) for a in asked], "lt string"), spark.createDataFrame([(t,) for t in titles], "rt string")
    assert {tuple(r) for r in biblio.found_titles(left, right).collect()} == want


def test_worksheet_and_enrichment(spark):
    paired = spark.createDataFrame([("k", "s1", "PAIRED", "doi", "x" * 2000, "abstract"), ("k", "s2", "PAIRED", "doi", "x" * 2000, "abstract"), ("m", "s3", "NO-BIB-ENTRY", None, None, None)], "cited string, sentence string, status string, matched_by string, abstract_text string, abstract_src string")
    bib = spark.createDataFrame([("k", "T", 1)], "citekey string, title string, ord int")
    assert {(r.citekey, r.title, r.claims, len(r.abstract or "")) for r in biblio.worksheet(paired, bib).collect()} == {("k", "T", 2, 1200), ("m", None, 1, 0)}
    assert {r.status: (r.instances, r["keys"]) for r in biblio.worksheet_counts(paired).collect()} == {"PAIRED": (2, 1), "NO-ABSTRACT": (0, 0), "NOT-IN-STORE": (0, 0), "NO-BIB-ENTRY": (1, 1)}
    papers = spark.createDataFrame([("a", "Deep nets", None, None, None, None, {"DOI": "10.1/A"}), ("b", "Deep trees of old", " ", None, None, None, None), ("c", "Deep trees of old", None, None, None, None, None), ("d", "x", "has one", None, None, None, None)], "paperid string, title string, abstract string, _abstract_openalex string, _abstract_source string, _openalex_id string, externalids map<string,string>")
    index = "map<string,array<int>>"
    by_doi = spark.createDataFrame([("10.1/a", {"two": [1], "one": [0]}, "w1")], f"doi string, index {index}, work_id string")
    by_title = spark.createDataFrame([("b", "Deep trees, of old!", {"t": [0]}, "w2"), ("c", "Shallow water", {"u": [0]}, "w3"), ("d", "x", {"v": [0]}, "w4")], f"paperid string, title string, index {index}, work_id string")
    got = {r.paperid: (r._abstract_openalex, r._abstract_source, r._openalex_id) for r in store.enrich(papers, by_doi, by_title).collect()}
    assert got == {"a": ("one two", "openalex", "w1"), "b": ("t", "openalex", "w2"), "c": (None, None, None), "d": (None, None, None)}


def test_worksheet_has_whole_abstracts(spark, small, tmp_path):
    from attestra.plans.papers import PAPERS

    old = {n: spark.read.parquet(f"{small}/{n}.parquet") for n in ("papers", "bib_records", "documents")}
    long = "".join(f"Sentence {i} of it. " for i in range(200)).strip()
    old["papers"].filter("title is not null").withColumn("title", F.concat(F.lit("Work "), F.xxhash64("paperid").cast("string"))).withColumn("abstract", F.lit(long)).write.parquet(f"{tmp_path}/papers.parquet")
    title = spark.read.parquet(f"{tmp_path}/papers.parquet").agg(F.min("title")).first()[0]
    old["bib_records"].limit(1).withColumns({"citekey": F.lit("k"), "title": F.lit(title), "doi": F.lit(None).cast("string")}).write.parquet(f"{tmp_path}/bib_records.parquet")
    old["documents"].limit(1).withColumn("text", F.lit("As shown \\cite{k}.")).write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.citekey, r.status, r.abstract) for r in PAPERS.queries["cite_worksheet"](spark, str(tmp_path)).collect()] == [("k", "PAIRED", long)]


def test_store_versions_and_maps(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert store.load_store(spark, folder) is None
    own = spark.createDataFrame([("a", "T", ["search:x"])], "paperid string, title string, sources array<string>")
    store.save_store(own, folder)
    more = store.arrivals(spark.createDataFrame([("y", 1, "a", "U"), ("y", 2, "b", "V"), ("y", 3, "c", "W"), ("y", 4, None, "Z")], "query string, rank int, paperid string, title string"), "search", 2)
    merged = store.upsert(store.load_store(spark, folder), more)
    store.save_store(merged, folder)
    assert {(r.paperid, r.title, tuple(r.sources)) for r in store.load_store(spark, folder).collect()} == {("a", "T", ("search:x", "search:y")), ("b", "V", ("search:y",))}
    assert store.load_store(spark, folder, 1).count() == 1 and store.stored_versions(spark, folder) == [1, 2]
    from attestra.operators import study

    (tmp_path / "studies.json").write_text(json.dumps({"n.ipynb::2019": "S", "m::": None}))
    assert {tuple(r) for r in study.load_study_map(spark, str(tmp_path / "studies.json")).collect()} == {("n.ipynb", "2019", "S"), ("m", "", None)} and study.load_study_map(spark) is None
    with pytest.raises(Exception):
        study.load_study_map(spark, str(tmp_path / "none.json")).collect()


def test_gate(spark):
    rows = spark.createDataFrame([("a", True, True), ("b", False, False), ("c", None, True)], "name string, required boolean, ok boolean")
    assert tuple(gate.verdict(rows).first()) == (True, 0, 1)
    assert gate.verdict(rows.withColumn("ok", F.lit(False))).first().failed == 2
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "n")], "k int, v string")
    assert {(r.key, r.state) for r in gate.verify_freeze(gate.row_freeze(a, "k"), gate.row_freeze(b, "k")).collect()} == {(1, "ok"), (2, "CHANGED"), (3, "MISSING")}


def test_sweeps(spark):
    lines = spark.createDataFrame([("| run_id | account |",), ("| s-run001 | me | lr=1 | complete | A=1% | 3.5 | now |",), ("| s-run002 | me | lr=2 | FAILED (incomplete) | | x | now |",)], "value string")
    journal = sweep.parse_journal(lines)
    assert [(r.run_id, r.runtime_s) for r in journal.collect()] == [("s-run001", 3.5), ("s-run002", None)]
    runs = spark.createDataFrame([("s-run001",), ("s-run002",), ("s-run003",)], "run_id string")
    assert sorted(r.run_id for r in sweep.pending(runs, journal).collect()) == ["s-run002", "s-run003"] and sweep.pending(runs, journal, exact=False).count() == 1
    assert [r[0] for r in spark.createDataFrame([("1",), ("True",), ("[1, 2]",), ("abc",), (None,)], "v string").select(sweep.literal_text("v")).collect()] == ["1", "True", "[1, 2]", "'abc'", None]


def test_files_and_streams(spark, tmp_path):
    folder = tmp_path / "runs"
    folder.mkdir()
    for i, (seed, time, mape) in enumerate([(1, "2024-01-01", "1.5"), (1, "2024-02-01", "NaN"), (2, "2024-01-01", "2.5")]):
        (folder / f"r{i}.json").write_text(f'{{"notebook": "n", "seed": {seed}, "smoke_test": false, "timestamp_utc": "{time}", "results": {{"A": {{"mape": {mape}}}}}}}')
    (folder / "bad.json").write_text('{"notebook": "n", "seed"')
    scanned = files.result_files(spark, str(folder))
    assert scanned.filter("parse_error").count() == 1 and files.readable_runs(scanned).count() == 3
    marks = files.fingerprints(spark, str(folder), "*.json")
    assert marks.count() == 4 and len(marks.first().sha256) == 64
    target, checkpoint = str(tmp_path / "kept"), str(tmp_path / "state")
    landing.keep_newest(landing.landing_runs(spark, str(folder), 1), target, checkpoint).awaitTermination()
    kept = {(r.seed, r.timestamp_utc) for r in landing.latest_version(spark, target).collect()}
    assert kept == {(1, "2024-02-01"), (2, "2024-01-01")}
    logs = tmp_path / "log"
    files.append_log(spark.createDataFrame([(1, "t", "finding", "x"), (2, "t", "next", "y")], "id bigint, track string, type string, text string"), str(logs))
    assert files.log_lines(spark, str(logs)).count() == 2
    query = landing.log_tail(spark, str(logs)).writeStream.format("memory").queryName("tail").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.track, r.id) for r in spark.table("tail").collect()] == [("t", 2)]
    (tmp_path / "one.json").write_text(json.dumps({"a": 1}))


def test_watch_stream(spark, tmp_path):
    hits = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3)], "paperid string, n int")
    hits.write.parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "hits"))
    query = landing.watch(stream, spark.createDataFrame([("a",)], "paperid string")).writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.paperid for r in spark.table("fresh").collect()} == {"b", "c"}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, []), (5, None)], "vec_id bigint, embedding array<double>")
    asked = rows.filter("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert [r.vec_id for r in store.nearest_vectors(rows, asked, 2, block_rows=2).orderBy("place").collect()] == [2, 3]


def test_audit_of_pages_and_unpublished_works(spark):
    entries = spark.createDataFrame(
        [(1, "A page", None, "misc", "http://a", 200, False, False), (2, "A page", None, "online", "http://a", 404, False, False), (3, "Not out yet", None, "article", None, None, True, True), (4, "Deep nets of old", None, "article", None, None, True, False)],
        "entry int, title string, doi string, type string, url string, url_status int, in_journal boolean, unpublished boolean",
    ).withColumns({"year": F.lit(2000), "venue": F.lit("v")})
    records = spark.createDataFrame([("p", 1, "Deep nets of old", 2000, None, "10.1/a", None)], "record string, ord int, title string, year int, venue string, doi string, retracted boolean")
    got = {r.entry: r for r in biblio.audit(entries, records).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["NON-PAPER-OK", "UNVERIFIABLE", "UNVERIFIABLE", "VERIFIED"] and got[4].suggest == ["doi = {10.1/a}"] and got[4].notes == ["retraction status could not be checked"]
    assert [r[0] for r in spark.createDataFrame([(200,), (302,), (403,), (404,), (None,)], "s int").select(biblio.url_alive(F.col("s"))).collect()] == [True, True, True, False, False]


def test_records_from_answers(spark):
    primary = spark.sql("select 'p' paperId, 'T' title, 2001 year, '' venue, map('DOI', '10.1/A') externalIds, cast(null as array<string>) publicationTypes")
    assert tuple(biblio.record_from_primary(primary).first()) == ("primary", "p", "T", 2001, None, "10.1/a", None, [])
    registry = spark.sql("select '10.1/B' DOI, array('T') title, array('J') container, 'journal-article' type, cast(null as array<int>) print, array(2003, 1) online, array(2002) issued, array(2001) created")
    assert biblio.record_from_registry(registry).first().year == 2003


def test_verify_many_files(spark):
    def profiled(name, sha, rows):
        return profile.profile(rows, "y").withColumns({"file": F.lit(name), "sha256": F.lit(sha)})

    good, poor = spark.createDataFrame([("1", "a"), ("2", "b")], "x string, y string"), spark.createDataFrame([("1", "a"), ("1", "b")], "x string, y string")
    old = profiled("a", "s1", good).union(profiled("b", "s2", good)).union(profiled("gone", "s", good))
    new = profiled("a", "s1", good).union(profiled("b", "s3", poor)).union(profiled("new", "s", good))
    got = {(r.file, r.severity, r.why) for r in profile.verify(old, new).collect()}
    assert got == {("gone", "FAIL", "missing"), ("new", "warn", "new file"), ("b", "FAIL", "x: collapsed to a constant"), ("b", "warn", "x: content changed"), ("b", "FAIL", "x: CONSTANT")}


def test_file_streams(spark, tmp_path):
    import hashlib

    (tmp_path / "a.csv").write_text("x, y,z\n1,a,\n2 ,b\n,a,NaN,9\ninf,a,n/a\n")
    (tmp_path / "b.CSV").write_bytes(b"")
    (tmp_path / "noext").write_bytes(b"\x00" * 3_000_000)
    marks = {r.path.rsplit("/", 1)[1]: r for r in files.fingerprints(spark, str(tmp_path)).collect()}
    assert marks["noext"].sha256 == hashlib.sha256(b"\x00" * 3_000_000).hexdigest() and marks["noext"].format == "raw" and marks["b.CSV"].format == "csv" and marks["a.csv"].bytes == (tmp_path / "a.csv").stat().st_size
    got = {r.column: r for r in files.csv_fingerprints(spark, str(tmp_path), "*.[cC][sS][vV]").collect()}
    assert set(got) == {"x", " y", "z"} and (got["x"].rows, got["x"].nulls, got["x"].distinct, got["x"].min, got["x"].max) == (4, 1, 3, 1.0, float("inf")) and got["z"].nulls == 4 and got[" y"].distinct == 2
    assert got[" y"].col_hash == hashlib.sha256("a\x1fb\x1fa\x1fa\x1f".encode()).hexdigest()[:16] and profile.degeneracies(spark.createDataFrame(list(got.values()))).filter("column = 'z'").first().problem == "ALL-NULL"
    shapes = "path string, shape array<bigint>, dtype string, nans bigint, constant boolean"
    old, new = spark.createDataFrame([("p", [2, 2], "f8", 0, False), ("q", [3], "i4", 0, False)], shapes), spark.createDataFrame([("p", [2, 3], "f8", 4, False), ("q", [3], "i4", 0, True)], shapes)
    assert {(r.path, r.severity, r.change) for r in profile.array_drift(old, new).collect()} == {("p", "hard", "shape: [2, 2] -> [2, 3]"), ("p", "hard", "nans: 0 -> 4")}
    assert {tuple(r) for r in profile.array_problems(new).collect()} == {("p", "4 NaN"), ("q", "CONSTANT")}
    landed = files.parse_runs(spark.createDataFrame([(1, '{"notebook": "n", "seed": 1, "results": {"A": {"mape": 1, "rmse": 1, "mae": NaN}}}'), (2, "{")], "run_id int, value string"))
    assert {r.run_id: (r.tag, r.bad) for r in integrity.findings(landed, ["A"], {}).collect()} == {1: ("FAIL", ["A.mae"]), 2: ("UNREADABLE", None)}


def test_sweep_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "sweep.yaml").write_text("kernel_slug_prefix: p\nruns:\n  - {SEED: 1, X: a}\n  - {SEED: 2}\n")
    got = sweep.expand(sweep.load_sweep(spark, str(tmp_path / "sweep.yaml"))).collect()
    assert [(r.run_id, r.params) for r in got] == [("p-run001", {"SEED": "1", "X": "a"}), ("p-run002", {"SEED": "2"})]
    (tmp_path / "accounts.yaml").write_text("accounts:\n  - {name: a, kaggle_username: u, token_file: t}\n")
    assert [tuple(r) for r in sweep.accounts(spark, str(tmp_path / "accounts.yaml")).collect()] == [("a", "u")] and sweep.accounts(spark, str(tmp_path / "none.yaml")).count() == 0


def test_npy_steps_ranks_reports(spark, tmp_path):
    import numpy as np

    from attestra import reports

    np.save(tmp_path / "a.npy", np.array([[1.0, np.nan], [2.0, 3.0]]))
    np.save(tmp_path / "b.npy", np.zeros(3, dtype=int))
    (tmp_path / "c.npy").write_bytes(b"no array")
    got = {r.path[-5:]: r for r in files.npy_profile(spark, str(tmp_path)).collect()}
    assert (got["a.npy"].shape, got["a.npy"].nans, got["a.npy"].max) == ([2, 2], 1, 3.0) and got["b.npy"].constant and got["c.npy"].dtype is None
    steps = gate.run_steps(spark, {"fine": (lambda: spark.range(0), True), "found": (lambda: spark.range(2), False), "broken": (lambda: spark.sql("select nothing"), True)})
    assert {(r.name, r.ok) for r in steps.collect()} == {("fine", True), ("found", False), ("broken", False)} and gate.verdict(steps).first().failed == 1
    papers = spark.createDataFrame([(f"p{i}", i % 7, i % 3) for i in range(200)], "paperid string, citationcount bigint, influentialcitationcount bigint")
    rated = papers.select("paperid", (F.col("citationcount") / 6).alias("relevance"))
    ranks = {r.paperid: r.rank for r in store.ranked(papers, rated).collect()}
    want = sorted(papers.collect(), key=lambda r: (-(r.citationcount / 6), -(3 * r.influentialcitationcount + r.citationcount), r.paperid))
    assert [ranks[r.paperid] for r in want] == list(range(1, 201)) and store.ranked(papers).count() == 200
    text_ = reports.table(spark.createDataFrame([("a|b", 1.23456, None, [1, 2])], "x string, y double, z string, w array<int>"))
    assert "a\\|b" in text_ and "1.235" in text_ and "1, 2" in text_
    comments = spark.createDataFrame([("r.1", "r", 1, "c", None), ("r.2", "r", 2, "d", "answer")], "id string, reviewer string, ord int, text string, response string")
    letter = [r.value for r in reports.response_letter(comments).orderBy("reviewer", "ord").collect()]
    assert letter[0].startswith("## Reviewer r") and "[RESPONSE PENDING]" in letter[0] and "answer" in letter[1] and "##" not in letter[1]
    status = spark.createDataFrame([("complete", False), ("timeout", False), (None, True)], "s string, d boolean").select(sweep.run_status(F.col("s"), F.col("d")))
    assert [r[0] for r in status.collect()] == ["complete", "FAILED (timeout)", "dry_run"]
    row = spark.createDataFrame([("s-run001", "me", "lr=1", "complete", "A", 1.5, "now")], "run_id string, account string, params string, status string, summary string, runtime_s double, timestamp string")
    sweep.append_journal(row, str(tmp_path / "journal"))
    assert sweep.parse_journal(spark.read.text(str(tmp_path / "journal"))).first().runtime_s == 1.5
