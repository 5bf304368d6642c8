"""Review comments, responses and their check against a diff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text
from attestra.functions.running import numbered

# Where a numbered item of a review begins, and the least length of a comment.
ITEM = r"\n\s*(?=(?:\d+[.):]|[A-Z]\d+[.:]))"
LEAST = 15
ACTIONS = ("change", "clarify", "decline")


def split_comments(reviews: DataFrame, key: str = "doc_id") -> DataFrame:
    """``<key>, pos, text``: the items of each review, or its paragraphs where it has fewer than two parts.

    White space is collapsed; parts under ``LEAST`` characters are left out; positions count the kept ones from 1.
    """
    whole = text.unix_lines(F.col("text"))
    items = F.split(whole, text.UNICODE + ITEM)
    parts = F.when(F.size(items) >= 2, items).otherwise(F.split(whole, text.UNICODE + r"\n\s*\n"))
    clean = F.filter(F.transform(parts, text.collapsed), lambda p: F.length(p) >= LEAST)
    return reviews.select(key, F.posexplode(clean).alias("_p", "text")).select(key, (F.col("_p") + 1).alias("pos"), "text")


def comment_ids(comments: DataFrame) -> DataFrame:
    """Ids ``reviewer.n`` in order of ``ord``, which must be unique, for each reviewer; a null reviewer is ``?``."""
    named = comments.withColumn("reviewer", F.coalesce("reviewer", F.lit("?")))
    placed = numbered(named, ["ord"], "_n", ["reviewer"])
    return placed.withColumn("id", F.concat_ws(".", "reviewer", F.col("_n").cast("string"))).drop("_n")


#: A comment of a store.
COMMENT = "id string, reviewer string, text string, response string, action string, anchors array<string>, quote string"


def init(spark: SparkSession) -> DataFrame:
    """An empty store of comments."""
    return spark.createDataFrame([], COMMENT)


def add(store: DataFrame, comments: DataFrame) -> DataFrame:
    """The store with further comments (``reviewer, ord, text``), whose numbers go on after those of their reviewer."""
    held = store.groupBy("reviewer").agg(F.count(F.lit(1)).alias("_held"))
    placed = numbered(comments.select(F.coalesce("reviewer", F.lit("?")).alias("reviewer"), "ord", "text"), ["ord"], "_n", ["reviewer"]).join(held, "reviewer", "left")
    name = F.concat_ws(".", "reviewer", (F.col("_n") + F.coalesce("_held", F.lit(0))).cast("string"))
    fresh = placed.select(name.alias("id"), "reviewer", "text", *[F.lit(None).cast("string").alias(c) for c in ("response", "action")], F.array().cast("array<string>").alias("anchors"), F.lit(None).cast("string").alias("quote"))
    return store.unionByName(fresh)


def import_reviews(store: DataFrame, reviews: DataFrame) -> DataFrame:
    """The store with the comments of whole reviews (``reviewer, ord, text``), in order of ``ord`` and place."""
    parts = split_comments(reviews.select(F.struct("ord", "reviewer").alias("_k"), "text"), "_k")
    return add(store, parts.select(F.col("_k.reviewer").alias("reviewer"), F.struct(F.col("_k.ord").alias("o"), F.col("pos").alias("p")).alias("ord"), "text"))


def respond(store: DataFrame, answers: DataFrame) -> DataFrame:
    """The store with answers (``id, text, action, anchors, quote``; ``anchors`` parted by commas) in place of earlier ones.

    A null action is ``change`` where anchors or a quote are given, else ``clarify``. Answers to unknown comments and
    with other actions change nothing (``unknown_answers`` names them).
    """
    good = answers.filter(F.col("action").isNull() | F.col("action").isin(*ACTIONS))
    parts = F.filter(F.transform(F.split(F.coalesce("anchors", F.lit("")), ","), text.stripped), lambda a: a != "")
    said = F.when((F.coalesce("anchors", F.lit("")) != "") | (F.coalesce("quote", F.lit("")) != ""), "change").otherwise("clarify")
    new = good.select("id", F.struct(F.col("text").alias("response"), F.coalesce("action", said).alias("action"), parts.alias("anchors"), "quote").alias("_new"))
    both = store.join(new, "id", "left")
    kept = ("response", "action", "anchors", "quote")
    return both.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in store.columns])


def unknown_answers(store: DataFrame, answers: DataFrame) -> DataFrame:
    """``id, problem`` of answers that ``respond`` leaves out, and of changes that can't be checked."""
    lost = answers.join(store.select("id"), "id", "left_anti").select("id", F.lit("unknown comment").alias("problem"))
    other = answers.filter(~F.col("action").isin(*ACTIONS)).select("id", F.lit("no action").alias("problem"))
    bare = (F.coalesce("anchors", F.lit("")) == "") & (F.coalesce("quote", F.lit("")) == "")
    return lost.unionByName(other).unionByName(answers.filter((F.col("action") == "change") & bare).select("id", F.lit("change without anchors or quote").alias("problem")))


def with_default_action(comments: DataFrame) -> DataFrame:
    backed = (F.coalesce(F.size("anchors"), F.lit(0)) > 0) | (F.coalesce("quote", F.lit("")) != "")
    return comments.withColumn("action", F.coalesce("action", F.when(F.col("response").isNotNull(), F.when(backed, "change").otherwise("clarify"))))


def status(comments: DataFrame) -> DataFrame:
    return comments.groupBy("reviewer").agg(F.count(F.lit(1)).alias("comments"), F.count_if(F.coalesce(F.col("response"), F.lit("")) == "").alias("open"))


# Fixed value: the line of a unified diff that names a file.
DIFF_FILE = r"\A\+\+\+ (?:b/)?(.+)"


def parse_diff(lines: DataFrame, key: str = "diff_id") -> tuple[DataFrame, DataFrame]:
    """Files (``<key>, file``) that a diff touches, and the added text (``<key>, added``), white space collapsed.

    ``lines``: ``<key>, line_no, line``. Added lines are joined as they stand in the diff, each with its end. A
    diff is one document, so its lines meet in one row.
    """
    name = F.regexp_extract("line", text.UNICODE + DIFF_FILE, 1)
    files = lines.select(key, name.alias("_f")).filter("_f <> '' and _f <> '/dev/null'").select(key, text.stripped(F.col("_f")).alias("file")).distinct()
    plus = lines.filter(F.col("line").startswith("+") & ~F.col("line").startswith("+++"))
    rows = plus.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", F.expr("substring(line, 2)").alias("t")))).alias("l"))
    added = rows.select(key, F.regexp_replace(F.concat(F.array_join(F.transform("l", lambda s: s["t"]), "\n"), F.lit("\n")), r"(?U)\s+", " ").alias("added"))
    return files, added


def check_responses(comments: DataFrame, files: DataFrame, added: DataFrame, manuscript: DataFrame) -> DataFrame:
    """``id, verdict, why``: FAIL for open comments, changes whose anchors or quote can't be found, or nothing recorded.

    ``files``: ``file`` of the diff; ``added``: the added text of each diff; ``manuscript``: ``text`` of each manuscript. A
    quote must be in any of these texts. An anchor is found by the same base name or as the end of a path.
    ``why`` lists all reasons. Empty responses and quotes count as none.
    """
    changes = comments.filter(F.col("action") == "change")
    anchors = changes.select("id", F.explode("anchors").alias("anchor"))
    base = F.element_at(F.split("anchor", "/"), -1)
    named = files.select("file", F.element_at(F.split("file", "/"), -1).alias("_base"))
    # An end of a path has its base name too, so the base name is the key of the join.
    found = anchors.withColumn("_base", base).join(named, "_base").select("id", "anchor").distinct()
    missing = anchors.distinct().join(found, ["id", "anchor"], "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("lost"))
    told = F.coalesce(F.col("response"), F.lit("")) != ""
    quote = text.collapsed(F.coalesce("quote", F.lit("")))
    # Distinct quotes are looked for in every text: two small sides, whose product is the work itself.
    quotes = changes.filter(told).select(quote.alias("_q")).filter("_q <> ''").distinct()
    texts = added.select(F.col("added").alias("_t")).unionByName(manuscript.select(F.regexp_replace("text", r"(?U)\s+", " ").alias("_t"))).filter("_t is not null")
    seen = quotes.join(texts, F.contains("_t", F.col("_q")), "left_semi").withColumn("_quoted", F.lit(True))
    both = comments.withColumn("_q", quote).join(missing, "id", "left").join(seen, "_q", "left")
    bare = (F.coalesce(F.size("anchors"), F.lit(0)) <= 0) & (F.col("_q") == "")
    change = told & (F.col("action") == "change")
    why = F.concat_ws("; ", F.when(~told, "unanswered"), F.when(change & (F.coalesce("lost", F.lit(0)) > 0), "anchor not in diff"), F.when(change & (F.col("_q") != "") & F.col("_quoted").isNull(), "quote not found"), F.when(change & bare, "nothing recorded"))
    return both.select("id", F.when(why == "", "ok").otherwise("FAIL").alias("verdict"), F.nullif(why, F.lit("")).alias("why"))
