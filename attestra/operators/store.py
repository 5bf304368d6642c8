"""A store of papers: upserts with provenance, relevance to a focus, tiers, refreshes and watches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions import stats, text
from attestra.functions.running import numbered
from attestra.operators.biblio import title_likeness

#: Weight of a focus term by the field that has it.
FIELD_WEIGHTS = {"title": 3, "tldr": 2, "abstract": 1}
CORE, RELATED = 0.60, 0.30


def _filled(c: Column, kind: T.DataType) -> Column:
    """Neither null nor an empty text, array or map."""
    if isinstance(kind, T.StringType):
        return c.isNotNull() & (c != "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def merge(arrivals: DataFrame, key: str = "paperid", order: str = "row_id", source: str | None = "source") -> DataFrame:
    """One row per key: each field the first filled value in order of arrival, sources in that order.

    A known key is only filled up, never overwritten. Rows without a key are left out. ``min_by`` with a
    filter combines before the shuffle, so a key that holds a third of all rows is no matter. ``sources``
    are the distinct ones by their first arrival.
    """
    fields = [f for f in arrivals.schema.fields if f.name not in (key, order, source)]
    rows = arrivals.filter(F.col(key).isNotNull())
    firsts = [F.min_by(F.when(_filled(F.col(f.name), f.dataType), F.col(f.name)), F.when(_filled(F.col(f.name), f.dataType), F.col(order))).alias(f.name) for f in fields]
    merged = rows.groupBy(key).agg(*firsts)
    if source is None:
        return merged
    seen = rows.filter(F.col(source).isNotNull()).groupBy(key, source).agg(F.min(order).alias("_o"))
    ordered = seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", source))), lambda s: s[source]).alias("sources"))
    return merged.join(ordered, key, "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def new_keys(store: DataFrame, arrivals: DataFrame, key: str = "paperid") -> DataFrame:
    return arrivals.select(key).filter(F.col(key).isNotNull()).distinct().join(store.select(key), key, "left_anti")


def influence() -> Column:
    """Three times the influential citations plus all, nulls as none."""
    return F.coalesce("influentialcitationcount", F.lit(0)) * 3 + F.coalesce("citationcount", F.lit(0))


def top_influence(papers: DataFrame, k: int) -> DataFrame:
    return papers.withColumn("influence", influence()).orderBy(F.col("influence").desc(), "paperid").limit(k)


def relevance(papers: DataFrame, focus: str) -> DataFrame:
    """``paperid, score, relevance, matched``: weighted rare focus words in title, short text and abstract.

    ``papers``: ``paperid, title, tldr, abstract`` (texts). idf = ln((N+1)/(df+1)) + 1, counted for the words
    of the focus alone. ``relevance`` is the share of the greatest score, 0 where none matches. ``matched``
    goes by idf, then word. A focus without words is an error.
    """
    terms = sorted({r.t for r in papers.sparkSession.range(1).select(F.explode(text.tokens(F.lit(focus))).alias("t")).collect()})
    if not terms:
        raise ValueError("the focus has no words")
    wanted = F.array(*[F.lit(t) for t in terms])
    hits = papers.select("paperid", *[F.array_intersect(text.tokens(F.col(f)), wanted).alias(f"_{f}") for f in FIELD_WEIGHTS])
    any_field = F.array_union(F.array_union("_title", "_tldr"), F.col("_abstract"))
    counts = hits.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains(any_field, t)).alias(f"df_{i}") for i, t in enumerate(terms)])
    # One row: as many idf values as the focus has words.
    idf = counts.select(F.map_from_arrays(wanted, F.array(*[F.log((F.col("n") + 1) / (F.col(f"df_{i}") + 1)) + 1 for i in range(len(terms))])).alias("_idf"))
    scored = hits.crossJoin(F.broadcast(idf))
    weigh = lambda f: F.aggregate(F.transform(f"_{f}", lambda t: F.element_at("_idf", t)), F.lit(0.0), lambda a, x: a + x) * FIELD_WEIGHTS[f]
    score = sum((weigh(f) for f in FIELD_WEIGHTS), F.lit(0.0))
    matched = F.transform(F.array_sort(F.transform(any_field, lambda t: F.struct((-F.element_at("_idf", t)).alias("i"), t.alias("t")))), lambda s: s["t"])
    flat = scored.select("paperid", score.alias("score"), matched.alias("matched"))
    top = F.broadcast(flat.agg(F.max("score").alias("_max")))  # a single row
    return flat.crossJoin(top).select("paperid", "score", F.when(F.col("_max") > 0, F.col("score") / F.col("_max")).otherwise(0.0).alias("relevance"), "matched")


def tier(score: Column) -> Column:
    return F.when(score >= CORE, "Core").when(score >= RELATED, "Related").otherwise("Peripheral")


def from_inverted_index(index: Column) -> Column:
    """Text of a map of words to places; null and empty maps give null. By place, then word."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    words = F.transform(F.array_sort(places), lambda s: s["w"])
    return F.nullif(F.array_join(words, " "), F.lit(""))


def source_kinds(sources: Column) -> Column:
    """Distinct parts before the first colon, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.split_part(s, F.lit(":"), F.lit(1)))))


def refresh(store: DataFrame, fetched: DataFrame, fields: tuple[str, ...], count: str = "citationcount") -> DataFrame:
    """The store with the given fields overwritten by non-null fetched ones, ``changed`` and ``dropped``.

    ``dropped``: the new count is below four fifths of the old one.
    """
    new = fetched.select("paperid", *[F.col(f).alias(f"_new_{f}") for f in fields])
    both = store.join(new, "paperid", "left")
    changed = F.lit(False)
    for f in fields:
        changed = changed | (F.col(f"_new_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_new_{f}")))
    dropped = F.coalesce(F.col(f"_new_{count}") < 0.8 * F.col(count), F.lit(False))
    out = both.withColumn("changed", changed).withColumn("dropped", dropped)
    return out.withColumns({f: F.coalesce(F.col(f"_new_{f}"), F.col(f)) for f in fields}).drop(*[f"_new_{f}" for f in fields])


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _identifier(name: str) -> Column:
    return _present(F.try_element_at("externalids", F.lit(name)))


# What a file name and a key leave out of a text. Combining marks are no word characters.
UNNAMED, NO_WORD = r"[^\p{L}\p{N}_\- ]+", r"[^\p{L}\p{N}_]+"


def pdf_candidates(papers: DataFrame) -> DataFrame:
    """``paperid, candidates, basename``: links to try in order, and the file name to keep it under.

    The name is ``<year>_<title>``: letters, digits, hyphens and underscores of the title's first 80 characters.
    """
    arxiv = _identifier("ArXiv")
    links = F.array_distinct(F.array_compact(F.array(_present(F.col("openaccesspdf.url")), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv))))
    kept = F.regexp_replace(F.coalesce(_present(F.col("title")), F.col("paperid")), UNNAMED, "")
    slug = F.translate(text.stripped(F.substring(kept, 1, 80)), " ", "_")
    return papers.select("paperid", links.alias("candidates"), F.concat_ws("_", F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit("nd")), slug).alias("basename"))


def bibtex(papers: DataFrame) -> DataFrame:
    """``paperid, bibtex``: the stored entry, else a short one whose key is the last word of the first author and the year."""
    first = F.try_element_at("authors", F.lit(1))["name"]
    year = F.col("year").cast("string")
    last = F.element_at(F.filter(F.split(text.stripped(first), r"(?U)\s+"), lambda w: w != ""), -1)
    key = F.regexp_replace(F.concat(F.coalesce(last, F.lit("anon")), F.coalesce(F.nullif(year, F.lit("0")), F.lit(""))), NO_WORD, "")
    none = lambda c: F.coalesce(c, F.lit("None"))
    doi = F.coalesce(F.concat(F.lit("  doi = {"), _identifier("DOI"), F.lit("},\n")), F.lit(""))
    made = F.concat(F.lit("@article{"), key, F.lit(",\n  title = {"), none(F.col("title")), F.lit("},\n  year = {"), none(year), F.lit("},\n"), doi, F.lit("}"))
    return papers.select("paperid", text.stripped(F.coalesce(_present(F.col("citationstyles.bibtex")), made)).alias("bibtex"))


def filter_value(c: Column) -> Column:
    """Text for a filter of an index: commas and bars as spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(c, ",|", "  "), r"\s+", " "))


def ranked(papers: DataFrame, rated: DataFrame | None = None) -> DataFrame:
    """``paperid, tier, rank``: report order by relevance and influence, or influence alone; ties by ``paperid``.

    Ranks go on across tiers. Rows are range-partitioned by the whole order, so papers without any hit, which all
    have relevance 0, spread over as many tasks as others.
    """
    own = papers.select("paperid", influence().alias("_i"))
    own = own.withColumn("_r", F.lit(0.0)) if rated is None else own.join(rated.select("paperid", F.col("relevance").alias("_r")), "paperid")
    counted = numbered(own, [F.col("_r").desc(), F.col("_i").desc(), F.col("paperid")], "rank")
    return counted.select("paperid", *([] if rated is None else [tier(F.col("_r")).alias("tier")]), "rank")


def seed_paper(papers: DataFrame, wanted: str) -> DataFrame:
    """The paper with this id or DOI, whatever its case."""
    return papers.filter((F.col("paperid") == wanted) | (F.lower(F.try_element_at("externalids", F.lit("DOI"))) == wanted.lower()))


def intents(contexts: DataFrame) -> DataFrame:
    """``intent, contexts``: how often each intent occurs, ``(untagged)`` for none; ``contexts`` has an array ``intents``."""
    flat = contexts.select(F.explode_outer("intents").alias("i"))
    return flat.groupBy(F.coalesce("i", F.lit("(untagged)")).alias("intent")).agg(F.count(F.lit(1)).alias("contexts"))


def neighbours(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """``seed, paperid``: one hop along ``src -> dst`` edges, backwards or both ways. Seeds have ``seed``."""
    out = edges.join(seeds, edges["src"] == seeds["seed"]).select("seed", F.col("dst").alias("paperid"))
    back = edges.join(seeds, edges["dst"] == seeds["seed"]).select("seed", F.col("src").alias("paperid"))
    chosen = {"references": out, "citations": back, "both": out.unionByName(back)}[direction]
    return chosen.distinct()


def recovered_queries(papers: DataFrame, sources: str = "_sources") -> DataFrame:
    """``query, mode``: distinct ``search:`` and ``bulk:`` tags; the first mode seen of a query counts."""
    tags = papers.select("row_id", F.explode(sources).alias("tag")).filter(F.col("tag").rlike("^(?:search|bulk):"))
    parted = tags.select("row_id", F.split_part("tag", F.lit(":"), F.lit(1)).alias("mode"), F.regexp_replace("tag", "^[a-z]+:", "").alias("query"))
    return parted.groupBy("query").agg(F.min_by("mode", F.struct("row_id", "mode")).alias("mode"))


def watch_new(hits: DataFrame, store: DataFrame, since: int) -> DataFrame:
    """``paperid, query, year`` of hits since a year that the store lacks; the first query of a paper counts, then the first year."""
    fresh = hits.filter(F.col("year") >= since).join(store.select("paperid").distinct(), "paperid", "left_anti")
    return fresh.groupBy("paperid").agg(F.min_by(F.struct("query", "year"), F.struct("query", "year")).alias("h")).select("paperid", "h.*")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 1024) -> DataFrame:
    """``query_id, vec_id, cosine, place``: the k most alike vectors of each query, exact; no query meets itself.

    ``vectors``: ``vec_id, embedding``; ``queries``: ``query_id, q``, a stated query set. Both sides are cut into
    blocks of about ``block_rows``; every pair of blocks is one matrix product, and only the k best of each
    query in a pair go on. Null and empty vectors are left out.
    """
    unit = lambda rows: (m := np.stack([np.asarray(r, dtype=np.float64) for r in rows])) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def blocked(rows: DataFrame, key: str, column: str, out: str) -> DataFrame:
        good = rows.filter(F.size(column) > 0)
        blocks = max(1, -(-good.count() // block_rows))
        return good.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(column).alias("v"))).alias(out)).drop("_b")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asked, stored in zip(batch["asked"], batch["stored"]):
                names, wanted = np.array([s["k"] for s in stored]), np.array([a["k"] for a in asked])
                found = unit([a["v"] for a in asked]) @ unit([s["v"] for s in stored]).T
                top = np.lexsort((np.broadcast_to(names, found.shape), -found), axis=-1)[:, : k + 1]
                yield pd.DataFrame({"query_id": np.repeat(wanted, top.shape[1]), "vec_id": names[top].ravel(), "cosine": np.take_along_axis(found, top, 1).ravel()})

    met = blocked(queries, "query_id", "q", "asked").crossJoin(blocked(vectors, "vec_id", "embedding", "stored"))
    scored = met.mapInPandas(best, "query_id bigint, vec_id bigint, cosine double").filter("query_id <> vec_id")
    place = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return scored.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def entry_lines(papers: DataFrame, ranks: DataFrame, rated: DataFrame | None = None, cap: int = 650) -> DataFrame:
    """``rank, value``: each paper as a block of the index: title, venue, counts, sources, links, relevance and abstract.

    ``ranks``: ``paperid, rank``; ``rated``: ``paperid, relevance, matched``, whose first seven terms are shown. In order of
    ``rank`` the blocks are the index.
    """
    both = papers.join(ranks.select("paperid", "rank"), "paperid")
    both = both.join(rated.select("paperid", "relevance", "matched"), "paperid", "left") if rated is not None else both.withColumns({"relevance": F.lit(None).cast("double"), "matched": F.array().cast("array<string>")})
    doi, pdf = _identifier("DOI"), F.coalesce(_present(F.col("openaccesspdf.url")), F.concat(F.lit("https://arxiv.org/pdf/"), _identifier("ArXiv")))
    kinds = F.coalesce(_present(F.array_join(source_kinds(F.filter("_sources", lambda s: s.isNotNull())), ", ")), F.lit("-"))
    few = F.nullif("influentialcitationcount", F.lit(0))
    counts = F.concat(F.lit("cites "), F.coalesce("citationcount", F.lit(0)).cast("string"), F.coalesce(F.concat(F.lit(" (influential "), few.cast("string"), F.lit(")")), F.lit("")))
    meta = F.concat_ws(" · ", F.concat(F.lit("*"), _present(text.stripped(F.col("venue"))), F.lit("*")), counts, F.concat(F.lit("found via "), kinds))
    page = F.coalesce(_present(F.col("url")), F.concat(F.lit("https://www.semanticscholar.org/paper/"), "paperid"))
    links = F.concat_ws(" · ", F.concat(F.lit("[Semantic Scholar]("), page, F.lit(")")), F.concat(F.lit("[DOI:"), doi, F.lit("](https://doi.org/"), doi, F.lit(")")), F.concat(F.lit("[open-access PDF]("), pdf, F.lit(")")))
    terms = F.coalesce(_present(F.array_join(F.slice("matched", 1, 7), ", ")), F.lit("—"))
    rating = F.coalesce(F.concat(F.lit("**Relevance:** "), stats.format_numbers(F.lit(".2f"), F.col("relevance")), F.lit(" — matches: "), terms, F.lit("  \n")), F.lit(""))
    own, other, short = (_present(text.stripped(F.col(c))) for c in ("abstract", "_abstract_openalex", "tldr.text"))
    label = F.when(own.isNotNull(), "").when(other.isNotNull(), " *(abstract via OpenAlex)*").otherwise(" *(TL;DR (Semantic Scholar))*")
    told = F.coalesce(F.concat(F.lit("> "), text.shortened(F.coalesce(own, other, short), cap), label), F.lit("> *(abstract unavailable — verify before citing claims about this paper's content)*"))
    head = F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), text.stripped(F.coalesce(_present(F.col("title")), F.lit("(untitled)"))), F.lit(" ("), F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit("?")), F.lit(")"))
    return both.select("rank", F.concat(head, F.lit("\n\n"), meta, F.lit("  \n**Links:** "), links, F.lit("  \n"), rating, F.lit("\n"), told, F.lit("\n")).alias("value"))


# --- Answers of indexes, and the store as a table --------------------------------------------------

# Hits that a search and an exhaustive search take at most, and the likeness from which a found title is the paper's.
SEARCH_HITS, BULK_HITS, SAME_TITLE = 25, 300, 0.85


def arrivals(answers: DataFrame, mode: str, most: int | None = None, detail: str = "query") -> DataFrame:
    """Answers of an index (``<detail>, rank`` and fields of papers) as arrivals with ``source`` ``<mode>:<detail>``.

    ``mode`` is search, bulk, lookup, snowball-references and the like. Of each query the first ``most`` by ``rank`` count;
    answers without a paper are left out. Ranks are numbered once, so a query of any size is no single task.
    """
    kept = answers if most is None else numbered(answers, ["rank"], "_n", [detail]).filter(F.col("_n") <= most).drop("_n")
    return kept.filter(F.col("paperid").isNotNull()).withColumn("source", F.concat(F.lit(f"{mode}:"), F.col(detail))).drop(detail)


def upsert(store: DataFrame, more: DataFrame) -> DataFrame:
    """The store with arrivals (``paperid, rank, source`` and fields) merged in: known papers are only filled up.

    ``store``: ``paperid, sources`` and the same fields. Its own values and sources come first.
    """
    fields = [c for c in store.columns if c not in ("paperid", "sources")]
    tagged = F.posexplode_outer("sources").alias("_at", "source")
    old = store.select("paperid", *fields, tagged).select("paperid", *fields, "source", F.struct(F.lit(0).alias("new"), F.coalesce("_at", F.lit(0)).cast("bigint").alias("at"), F.lit("").alias("by")).alias("_order"))
    new = more.select("paperid", *fields, "source", F.struct(F.lit(1).alias("new"), F.col("rank").cast("bigint").alias("at"), F.col("source").alias("by")).alias("_order"))
    return merge(old.unionByName(new), order="_order")


def save_store(store: DataFrame, folder: str) -> str:
    """Writes the store as the next version under ``folder`` and returns its path; readers see whole versions only."""
    versions = stored_versions(store.sparkSession, folder)
    path = f"{folder}/v{(versions[-1] if versions else 0) + 1:012d}"
    store.write.mode("overwrite").parquet(path)
    return path


def load_store(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """The last whole version of a store, or the one asked for; None where there is none."""
    versions = stored_versions(spark, folder)
    wanted = version if version is not None else versions[-1] if versions else None
    return spark.read.parquet(f"{folder}/v{wanted:012d}") if wanted in versions else None


def stored_versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole versions under ``folder``, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path(folder)):
        return []
    names = [status.getPath().getName() for status in system.listStatus(path(folder))]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and system.exists(path(f"{folder}/{n}/_SUCCESS")))


def lookup(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """``asked, paperid``: the paper of each ``asked, id, title``: by id or DOI, else by the title in normal form, the first by id."""
    doi = F.lower(F.try_element_at("externalids", F.lit("DOI")))
    keys = papers.select("paperid", F.explode(F.array_compact(F.array(F.col("paperid"), F.concat(F.lit("doi:"), doi)))).alias("_k")).distinct()
    asked = wanted.select("asked", F.when(F.lower("id").startswith("doi:"), F.lower("id")).otherwise(F.col("id")).alias("_k"), F.nullif(text.spaced_title(F.col("title")), F.lit("")).alias("_t"))
    by_id = asked.join(keys, "_k").groupBy("asked").agg(F.min("paperid").alias("_by_id"))
    titles = papers.select("paperid", text.spaced_title(F.col("title")).alias("_t")).groupBy("_t").agg(F.min("paperid").alias("_by_title"))
    both = asked.join(by_id, "asked", "left").join(titles, "_t", "left")
    return both.select("asked", F.coalesce("_by_id", F.when(F.col("_k").isNull(), F.col("_by_title"))).alias("paperid"))


def contexts_ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (``ord, contexts, year`` and others) with ``rank``: those with a sentence first, then the latest year, then ``ord``."""
    shown = F.when(F.coalesce(F.size("contexts"), F.lit(0)) > 0, 0).otherwise(1)
    keyed = rows.withColumns({"_shown": shown, "_year": F.coalesce("year", F.lit(0))})
    return numbered(keyed, ["_shown", F.col("_year").desc(), "ord"], "rank").drop("_shown", "_year")


def enrich(papers: DataFrame, by_doi: DataFrame, by_title: DataFrame) -> DataFrame:
    """``papers`` with ``_abstract_openalex, _abstract_source, _openalex_id`` filled where there is no abstract at all.

    ``by_doi``: ``doi, index, work_id``, ``by_title``: ``paperid, title, index, work_id`` (the first hit for a paper's title), both with
    maps of words to places. A DOI's answer counts first. A hit counts if its title is as alike as ``SAME_TITLE``.
    """
    blank = lambda c: F.nullif(text.stripped(F.col(c)), F.lit(""))
    bare = blank("abstract").isNull() & F.nullif("_abstract_openalex", F.lit("")).isNull()
    works = by_doi.filter("doi is not null").groupBy(F.lower("doi").alias("_d")).agg(F.first(F.struct("index", "work_id")).alias("_one"))
    hits = by_title.groupBy("paperid").agg(F.first(F.struct(F.col("title").alias("t"), "index", "work_id")).alias("_two"))
    joined = papers.withColumns({"_bare": bare, "_d": F.when(bare, F.lower(F.try_element_at("externalids", F.lit("DOI"))))}).join(works, "_d", "left").join(hits, "paperid", "left")
    alike = title_likeness(text.spaced_title(F.coalesce("title", F.lit(""))), text.spaced_title(F.coalesce("_two.t", F.lit(""))))
    near = joined.withColumn("_near", F.when(F.col("_bare") & F.col("_one").isNull() & F.col("_two").isNotNull(), alike))
    work = F.when(F.col("_one").isNotNull(), F.col("_one")).when(F.col("_near") >= SAME_TITLE, F.struct("_two.index", "_two.work_id"))
    told = near.withColumn("_work", work).withColumn("_text", F.when(F.col("_bare"), from_inverted_index(F.col("_work.index"))))
    new = {"_abstract_openalex": F.col("_text"), "_abstract_source": F.lit("openalex"), "_openalex_id": F.col("_work.work_id")}
    return told.select(*[F.when(F.col("_text").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in papers.columns])


def watch_report(found: DataFrame) -> DataFrame:
    """New papers (``paperid, year`` and the counts of ``influence``) with ``rank``: latest year first, then influence, then ``paperid``."""
    keyed = found.withColumns({"_y": F.coalesce("year", F.lit(0)), "_i": influence()})
    return numbered(keyed, [F.col("_y").desc(), F.col("_i").desc(), "paperid"], "rank").drop("_y", "_i")
