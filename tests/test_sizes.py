"""What queries cost as tables grow, read from their plans, and that the cheaper way finds the same."""

import random
import re
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from attestra.llm import matching
from attestra.operators import biblio, claims
from attestra.session import cut_lineage


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_of_values_are_read_once(spark):
    pool = claims.ordered_pool(spark.range(3000).select((F.col("id") * 7 % 3001 / 10).alias("value"), F.concat(F.lit("p"), "id").alias("src"), F.col("id").alias("ord")))
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 0.0731 - 20).alias("val"))
    found = claims._nearest_by_ranges(rows, pool, "val")
    specs = [s for s in plan_of(found).split("windowspecdefinition(")[1:] if re.match(r"_part#\d+, ", s)]
    assert specs and not [s for s in specs if "unboundedfollowing" in s.split(" AS ")[0]]
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in claims._nearest_in_array(rows, pool.collect(), "val").collect()}


def test_frequent_words_are_searched_without_pairs_of_rows(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    titles = sorted({" ".join(rng.choices(words, k=5)) for _ in range(1500)})
    found = biblio.found_titles(spark.createDataFrame([(t + " w1",) for t in titles[::20]], "lt string"), spark.createDataFrame([(t,) for t in titles], "rt string"), block=100)
    df = {w: sum(w in t.split() for t in titles) for w in words}
    want = {(a, t) for a in (t + " w1" for t in titles[::20]) for t in sorted(titles, key=lambda t: (-sum((1 << 50) // df[w] ** 2 for w in set(a.split()) & set(t.split())), t))[:5]}
    assert {tuple(r) for r in found.collect()} == want
    assert "FlatMapCoGroupsInArrow" in plan_of(found)


def test_paths_of_the_audit_seek_no_title(spark, small):
    from attestra.plans.papers import PAPERS

    plan = plan_of(PAPERS.queries["bib_paths"](spark, small))
    assert "Arrow" not in plan and "Pandas" not in plan


def test_only_cited_entries_are_matched(spark):
    cited = spark.createDataFrame([(1, "a"), (2, "none"), (3, "b")], "doc_id int, cited string")
    bib = spark.createDataFrame([(k, f"a rather long title of the work {k}", None, i) for i, k in enumerate("abcdefgh")], "citekey string, title string, doi string, ord int")
    papers = spark.createDataFrame([("p" + k, f"a rather long title of the work {k}", None, i, None, None) for i, k in enumerate("abx")], "paperid string, title string, doi string, ord int, abstract_text string, abstract_src string")
    seen, match = [], biblio.match_papers
    try:
        biblio.match_papers = lambda entries, *rest: seen.append({r.citekey for r in entries.collect()}) or match(entries, *rest)
        got = {(r.doc_id, r.status, r.paperid) for r in biblio.pair_citations(cited, bib, papers).collect()}
    finally:
        biblio.match_papers = match
    assert seen == [{"a", "b"}] and got == {(1, "NO-ABSTRACT", "pa"), (2, "NO-BIB-ENTRY", None), (3, "NO-ABSTRACT", "pb")}


def test_equal_titles_are_joined(spark):
    titles = spark.createDataFrame([("x y",), ("long " * 50,), ("other",)], "lt string")
    found = biblio.alike_titles(titles, spark.createDataFrame([("x y",), ("x z",), ("long " * 50,)], "rt string"), 1.0)
    alone = SequenceMatcher(None, "long " * 50, "long " * 50).ratio()
    assert "FlatMapCoGroups" not in plan_of(found) and {tuple(r) for r in found.collect()} == {("x y", "x y", 1.0)} | ({("long " * 50, "long " * 50, alone)} if alone >= 1 else set())


def test_a_known_title_narrows_what_is_compared(spark):
    """Titles that are far from the best one known meet no more; ties and lesser likeness than the known one stay exact."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(40)]
    rights = sorted({" ".join(rng.choices(words, k=rng.randint(4, 9))) for _ in range(400)})
    lefts = sorted({(r + " " + rng.choice(words) if i % 3 else r[1:] + "z") for i, r in enumerate(rights[::4])} | {" ".join(rng.choices(words, k=6)) for _ in range(10)})
    ratios = {a: {b: SequenceMatcher(None, a, b).ratio() for b in rights} for a in lefts}
    want = {(a, b, x) for a, of in ratios.items() for b, x in of.items() if x == max(of.values()) and x >= 0.7}
    seen, block = [], biblio._in_blocks
    try:
        biblio._in_blocks = lambda some, *rest: seen.append(some.groupBy("lt").agg(F.count("*").alias("n"), F.first("floor").alias("floor")).collect()) or block(some, *rest)
        got = {tuple(r) for r in biblio.alike_titles(spark.createDataFrame([(a,) for a in lefts], "lt string"), spark.createDataFrame([(b,) for b in rights], "rt string"), 0.7, block=50).collect()}
    finally:
        biblio._in_blocks = block
    best = {a: max(x for b, c, x in got if b == a) for a in {a for a, _, _ in got}}
    assert {(a, b, x) for a, b, x in got if x == best[a]} == want
    near, far = ({r.lt: r for r in some} for some in seen)
    assert all(r.floor <= max(ratios[r.lt].values()) for r in [*near.values(), *far.values()] if r.floor > 0.7) and any(r.floor > 0.7 for r in near.values())
    every = lambda a: (len(a) * 1.3 / 0.7 - len(a) * 0.7 / 1.3) / biblio.LENGTHS
    close = [a for a in far if best.get(a, 0) > 0.9]
    assert close and all(far[a].n < every(a) / 2 for a in close)


def test_counts_of_pairs_store_none(spark, small):
    from attestra.plans.papers import PAPERS

    assert "Relation [" in plan_of(PAPERS.queries["cite_counts"](spark, small))


def test_worksheets_store_no_pairs(spark, small):
    from attestra.plans.papers import PAPERS

    assert "Relation [" in plan_of(PAPERS.queries["cite_worksheet"](spark, small))


def test_verdicts_are_counted_without_pairs_of_rows(spark, small):
    from attestra.plans.papers import PAPERS

    counted, audited = (PAPERS.queries[n](spark, small) for n in ("bib_verdict_counts", "bib_audit"))
    assert "FlatMapCoGroupsInArrow" in plan_of(counted)
    assert {(r.verdict, r.entries) for r in counted.collect()} == {(r.verdict, r["count"]) for r in audited.groupBy("verdict").count().collect()}


def test_what_a_cut_shuffled_is_deleted(spark):
    of = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = of()
    rows = spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 1000).alias("k")).count()
    cut = cut_lineage(rows)
    for _ in range(50):
        if not of() - before:
            break
        time.sleep(0.2)
    assert not of() - before and cut.count() == 1000 and rows.count() == 1000


def test_terms_of_a_pair_travel_as_lists(spark):
    """Each entry's and paper's terms are one row where pairs are scored; only terms that are read are rows by term."""
    rows = spark.createDataFrame([(i, [f"w{i % 7}", f"w{i % 11}", f"v{i}"]) for i in range(300)], "pid long, words array<string>")
    lists = rows.select("pid", F.lit(3).alias("length"), F.transform("words", lambda w: F.xxhash64(w)).alias("terms"))
    asked = rows.select(F.col("pid").alias("bib_id"), F.explode("words").alias("w")).select("bib_id", F.xxhash64("w").alias("term"), F.lit(0).alias("kind"))
    found = matching.candidates(asked, matching.postings_of(lists), lists)
    assert "Generate" not in plan_of(found) and {r.bib_id for r in found.filter("bib_id = pid").collect()} == set(range(300))


def test_entries_meet_papers_in_blocks(spark):
    """However many papers entries have to visit, a block visits about as many as the lists have terms, and all of it is found."""
    lists = spark.range(200).select(F.col("id").alias("pid"), F.lit(3).alias("length"), F.transform(F.array(F.col("id"), F.col("id") % 2 + 1000, F.col("id") % 3 + 2000), lambda t: F.xxhash64(t)).alias("terms"))
    asked = spark.range(200).select(F.col("id").alias("bib_id"), F.explode(F.array(F.col("id") % 2 + 1000, F.col("id") % 3 + 2000)).alias("t")).select("bib_id", F.xxhash64("t").alias("term"), F.lit(0).alias("kind"))
    entries = cut_lineage(matching._weighed(asked, lists))
    whole, (block, *more) = entries.agg(F.sum("visits")).first()[0], matching.blocks_of(entries, lists, 1)
    assert whole > 30 * 600 and len(more) + 1 == -(-whole // 600) and block.agg(F.sum("visits")).first()[0] < 3 * 600
    postings = matching.postings_of(lists)
    one, many = (sorted(tuple(r) for r in matching.candidates(asked.filter("bib_id < 40"), postings, lists, n).collect()) for n in (1 << 40, 2000))
    assert one == many and len({r[0] for r in one}) == 40
