"""Audit of bibliography entries against found records, and pairing of citations with abstracts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text
from attestra.functions.alike import LONG, most_alike, most_alike_of, ratio, sharing_most
from attestra.session import cut_lineage

# Verdicts, worst first.
ORDER = ("RETRACTED", "MISMATCH", "NOT-FOUND", "UNVERIFIABLE", "NON-PAPER-OK", "VERIFIED")
# Publishers and servers that are no journal, words of works that aren't out, and where these are looked for.
PUBLISHERS = ("otexts", "wiley", "springer", "elsevier", "mit press", "crc press", "academic press", "pearson", "mcgraw-hill", "o'reilly", "manning", "nber", "arxiv", "preprint")
UNPUBLISHED = ("submitted", "in press", "under review", "to appear", "preprint")
UNPUBLISHED_FIELDS = ("journal", "booktitle", "note", "year")
BY_DOI, BY_TITLE = "by DOI", "by title"
PAIRED, NO_ABSTRACT, NOT_IN_STORE, NO_ENTRY = "PAIRED", "NO-ABSTRACT", "NOT-IN-STORE", "NO-BIB-ENTRY"


def title_likeness(a: Column | str, b: Column | str) -> Column:
    """Ratio of matching blocks of two already normalised titles, in this order of arguments."""
    return F.pandas_udf(_likeness, "double")(a, b)


def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def year_gap(a: Column, b: Column) -> Column:
    """Difference of the years that two texts begin with; null where one has none."""
    year = lambda c: F.substring(F.trim(c.cast("string")), 1, 4).try_cast("int")
    return F.abs(year(a) - year(b))


def url_of(fields: Column) -> Column:
    """First ``\\url{}`` or link of howpublished, url and note, in this order."""
    def one(name: str) -> Column:
        value = F.try_element_at(fields, F.lit(name))
        inside, link = F.regexp_extract(value, r"\\url\{([^}]+)\}", 1), F.regexp_extract(value, r"(?U)https?://\S+", 0)
        return F.rtrim(F.coalesce(F.nullif(inside, F.lit("")), F.nullif(link, F.lit(""))), F.lit("}"))

    return F.coalesce(*[one(n) for n in ("howpublished", "url", "note")])


def looks_unpublished(fields: Column) -> Column:
    """Does journal, booktitle, note or year say that a work isn't out yet? ``fields`` is a map of texts."""
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in UNPUBLISHED_FIELDS]))
    return F.exists(F.array(*[F.lit(w) for w in UNPUBLISHED]), lambda w: F.contains(whole, w))


def venue_is_publisher(venue: Column) -> Column:
    return F.coalesce(F.lower(text.stripped(venue)).isin(*PUBLISHERS), F.lit(False))


def entry_fields(entries: DataFrame, fields: str = "fields") -> DataFrame:
    """Parsed entries (``type``, ``fields``) with the columns that ``audit`` reads of them."""
    of = lambda n: F.nullif(F.try_element_at(F.col(fields), F.lit(n)), F.lit(""))
    return entries.withColumns({
        "title": of("title"), "year": of("year"), "doi": of("doi"), "venue": F.coalesce(of("journal"), of("booktitle")), "in_journal": F.coalesce(of("journal"), of("booktitle")).isNotNull(),
        "url": url_of(F.col(fields)), "unpublished": looks_unpublished(F.col(fields)), "to_verify": F.contains(F.lower(F.coalesce(of("note"), F.lit(""))), F.lit("verify")),
    })


#: The weight of a word that one title alone has, and right titles of a word that are compared in one go.
WHOLE, LIST = 1 << 50, 20_000
# Fixed value: how many records a search gives back.
SEARCH_ROWS = 5


def found_titles(left: DataFrame, right: DataFrame, most: int = SEARCH_ROWS, block: int = LIST) -> DataFrame:
    """``lt, rt``: for each left title the ``most`` right ones that a search by all of its words ranks first.

    This stands for the search that a remote index answers: right titles are ranked by the summed rarity of the
    words they share, then by text; the rarity of a word is one over the square of the number of right titles that have
    it, in whole steps. It is exact: the titles of the rarest words are scored by all words they share, up to the first word that
    ``most`` titles have, which gives each left title a score that its last hit has at least; then those of all further words
    without which a right title could still reach it. Titles that share only words looked up neither time can't.
    """
    return _found(left, right, most, block).select("lt", F.explode("hits.rt").alias("rt"))


def _found(left: DataFrame, right: DataFrame, most: int, block: int) -> DataFrame:
    """``lt, hits``: what ``found_titles`` finds, as one row of ``n, rt`` for each left title."""
    parted = lambda d, c: d.select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("w")).filter("w <> ''")
    lw, rw = parted(left.select("lt").distinct(), "lt"), parted(right.select("rt").distinct(), "rt")
    count = rw.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    keyed = lw.join(count, "w").withColumn("s", F.floor(F.lit(WHOLE) / (F.col("df") * F.col("df"))).cast("bigint"))
    ranked = keyed.groupBy("lt").agg(F.array_sort(F.collect_list(F.struct("df", "w", "s"))).alias("_ws"))
    own = ranked.select("lt", F.array_join("_ws.w", " ").alias("words"), F.col("_ws.s").alias("s"), (F.size(F.filter("_ws", lambda x: x["df"] < most)) + 1).alias("_first"))
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def hits(asked: DataFrame) -> DataFrame:
        """``asked``: ``lt, words, s, w``. Pieces of long lists meet by their own; a bucket holds many words."""
        sought = asked.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nl")).join(count.select("w", F.ceil(F.col("df") / block).cast("int").alias("_nr")), "w")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        piece = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        bucket = lambda d: d.withColumn("_b", F.pmod(F.xxhash64("w", "i", "j"), F.lit(4 * tasks)).cast("int")).repartition(tasks, "_b").groupBy("_b")
        lefts = asked.join(sought, "w").select("lt", "words", "s", "w", piece("lt", "_nl").alias("i"), each("_nr").alias("j"))
        rights = rw.join(sought, "w").select("rt", "w", each("_nl").alias("i"), piece("rt", "_nr").alias("j"))
        return bucket(lefts).cogroup(bucket(rights)).applyInArrow(lambda a, b: sharing_most(a, b, most), "lt string, hits array<struct<n: bigint, rt: string>>")

    top = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))), 1, most)
    word = F.split("words", " ")
    first = hits(own.select("lt", "words", "s", F.explode(F.slice(word, F.lit(1), F.col("_first"))).alias("w"))).groupBy("lt").agg(top.alias("hits"))
    bounded = cut_lineage(own.join(first, "lt").withColumn("_floor", -F.try_element_at("hits", F.lit(most))["n"]))
    rest = lambda at: F.aggregate(F.slice("s", at, F.size("s")), F.lit(0).cast("bigint"), lambda x, y: x + y)
    may = F.filter(F.sequence(F.lit(1), F.size("s")), lambda at: (at > F.col("_first")) & (rest(at) >= F.coalesce("_floor", F.lit(0))))
    more = hits(bounded.select("lt", "words", "s", F.explode(F.transform(may, lambda at: F.element_at(word, at))).alias("w")))
    return bounded.select("lt", "hits").unionByName(more).groupBy("lt").agg(top.alias("hits"))


#: Lengths of titles that share a block, and titles of a block about; a block is compared in one task.
LENGTHS, BLOCK = 3, 16000
#: How much longer or shorter the titles are with which a title is compared first, and words of titles that are sought by their words.
NEAR, WORDS = 3, 40


def _seeds(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``lt, floor``: a likeness that some right title has, for left titles of which one has the same words but for one on either side."""
    def keyed(d: DataFrame, c: str) -> DataFrame:
        words = d.select(c, F.array_sort(F.filter(F.split(c, " "), lambda w: w != "")).alias("_ws")).filter(F.size("_ws").between(1, WORDS))
        dropped = F.filter(F.transform("_ws", lambda _, at: F.filter("_ws", lambda w, k: k != at)), lambda ws: F.size(ws) >= 2)
        return words.select(c, F.explode(F.array_distinct(F.transform(F.concat(F.array("_ws"), dropped), lambda ws: F.xxhash64(F.array_join(ws, " "))))).alias("_k"))

    # any two of a key will do, as they only tell how like the best is at least
    known = keyed(right, "rt").groupBy("_k").agg(F.array(F.min(F.xxhash64("rt")), F.max(F.xxhash64("rt"))).alias("_ids"))
    pairs = keyed(left, "lt").join(known, "_k").select("lt", F.explode("_ids").alias("_id")).distinct().join(right.withColumn("_id", F.xxhash64("rt")), "_id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield most_alike_of(list(batch["lt"]), [list(r) for r in batch["rts"]], least)

    best = pairs.groupBy("lt").agg(F.collect_list("rt").alias("rts")).mapInPandas(compare, "lt string, rt string, likeness double")
    return best.groupBy("lt").agg(F.max("likeness").alias("floor"))


def _in_blocks(lefts: DataFrame, rights: DataFrame, lengths: int, block: int) -> DataFrame:
    """``lt, rt, likeness`` of ``lefts`` (``lt, floor, _band``) with the right titles of their bands, from ``floor`` on."""
    rights = rights.withColumn("_band", F.floor(F.length("rt") / lengths))
    parts = lambda d, n: d.groupBy("_band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n))
    cut = F.broadcast(parts(lefts, "_nl").join(parts(rights, "_nr"), "_band"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    piece = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    keys = ["_band", "_i", "_j"]
    lefts = lefts.join(cut, "_band").select("lt", "floor", "_band", piece("lt", "_nl").alias("_i"), each("_nr").alias("_j"))
    rights = rights.join(cut, "_band").select("rt", "_band", each("_nl").alias("_i"), piece("rt", "_nr").alias("_j"))
    # so many tasks that AQE doesn't join small partitions: their work is the product of both sides
    spark = lefts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    blocks = lefts.repartition(tasks, *keys).groupBy(*keys).cogroup(rights.repartition(tasks, *keys).groupBy(*keys))
    return blocks.applyInPandas(lambda a, b: most_alike(list(a["lt"]), list(b["rt"]), list(a["floor"])), "lt string, rt string, likeness double")


def alike_titles(left: DataFrame, right: DataFrame, least: float, lengths: int = LENGTHS, block: int = BLOCK) -> DataFrame:
    """``lt, rt, likeness``: the most alike right titles of each left one among all of them, from ``least`` on.

    Equal titles are joined; with a ``least`` of 1 that is all, for titles that differ are less alike. The others meet in blocks of like length, for a likeness of ``x`` needs lengths
    within a factor of ``(2 - x) / x``: nothing that reaches it is left out. That is ``least``, or more where a title is known that is more alike:
    one with the same words but for one, then the most alike of about the same length. Both sides are cut into
    blocks of bounded size. A block gives its best, so the best of all is among the rows, along with lesser ones.
    """
    own, other = left.select("lt").filter("lt <> ''").distinct(), right.select("rt").filter("rt <> ''").distinct()
    short = own.filter(F.length("lt") < LONG)
    equal = short.join(other, F.col("lt") == F.col("rt"), "left_semi").select("lt", F.col("lt").alias("rt"), F.lit(1.0).alias("likeness"))
    if least >= 1:
        long = own.filter(F.length("lt") >= LONG).join(other, F.col("lt") == F.col("rt")).withColumn("likeness", title_likeness("lt", "rt"))
        return equal.unionByName(long.filter(F.col("likeness") >= least))
    equal, other = cut_lineage(equal), cut_lineage(other)
    rest = cut_lineage(own.join(equal.select("lt"), "lt", "left_anti"))
    known = cut_lineage(rest.join(_seeds(rest, other, least), "lt", "left").select("lt", F.coalesce("floor", F.lit(float(least))).alias("floor")))
    size, span = F.length("lt"), (2 - F.col("floor")) / F.col("floor")
    band = lambda n: F.floor(n / lengths)
    # a whole number more on both sides than the bounds, against rounding
    first, last = band(F.floor(size / span) - 1), band(F.ceil(size * span) + 1)
    bands = F.sequence(F.greatest(first, band(size - NEAR)), F.least(last, band(size + NEAR)))
    near = cut_lineage(_in_blocks(known.withColumn("_band", F.explode(bands)), other, lengths, block))
    better = known.withColumn("_near", bands).join(near.groupBy("lt").agg(F.max("likeness").alias("_best")), "lt", "left").select("lt", "_near", F.greatest("floor", "_best").alias("floor"))
    far = better.withColumn("_band", F.explode(F.array_except(F.sequence(first, last), "_near"))).select("lt", "floor", "_band")
    return equal.unionByName(near).unionByName(_in_blocks(far, other, lengths, block))


def best_title(entries: DataFrame, records: DataFrame, least: float = 0.55, search: bool = True) -> DataFrame:
    """``entry, record, likeness``: the most alike record of each entry; the first record on ties.

    ``entries`` has ``entry, lt`` and ``records`` has ``record, ord, rt``, titles normalised. With ``search`` only
    what ``found_titles`` finds is compared, else all records; then titles must be bare.
    """
    known = records.filter("rt <> ''")
    if search:
        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield most_alike_of(list(batch["lt"]), [list(r) for r in batch["rts"]], least)

        pairs = _found(entries, known, SEARCH_ROWS, LIST).select("lt", F.col("hits.rt").alias("rts")).mapInPandas(compare, "lt string, rt string, likeness double")
    else:
        pairs = alike_titles(entries, known, least)
    firsts = known.groupBy("rt").agg(F.min_by("record", "ord").alias("record"), F.min("ord").alias("ord"))
    scored = entries.join(pairs, "lt").join(firsts, "rt")
    best = scored.groupBy("entry").agg(F.max_by(F.struct("record", "likeness"), F.struct("likeness", (-F.col("ord")).alias("o"))).alias("b"))
    return best.select("entry", "b.record", "b.likeness")


# Answers that say that a link is there, beside all of 200 to 399.
ALIVE = (401, 403, 405, 406, 429)


def url_alive(status: Column) -> Column:
    """Does an HTTP status say that the page is there? Null status: no answer, not alive."""
    return F.coalesce(status.between(200, 399) | status.isin(*ALIVE), F.lit(False))


def record_from_primary(payloads: DataFrame) -> DataFrame:
    """Records from answers of a paper index: ``paperId, title, year, venue, externalIds, publicationTypes``."""
    ids = F.col("externalIds")
    return payloads.select(
        F.lit("primary").alias("src"), F.col("paperId").alias("record"), "title", "year", F.nullif("venue", F.lit("")).alias("venue"), text.norm_doi(F.try_element_at(ids, F.lit("DOI"))).alias("doi"),
        F.try_element_at(ids, F.lit("ArXiv")).alias("arxiv"), F.coalesce("publicationTypes", F.array().cast("array<string>")).alias("types"),
    )


def record_from_registry(payloads: DataFrame) -> DataFrame:
    """Records from answers of a DOI registry; the year is that of print, else online, issued, created.

    ``payloads``: ``DOI, title array, container array, type`` and ``print, online, issued, created`` as arrays
    of date parts.
    """
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return payloads.select(
        F.lit("registry").alias("src"), F.col("DOI").alias("record"), first("title").alias("title"), F.coalesce(*[first(c) for c in ("print", "online", "issued", "created")]).alias("year"), first("container").alias("venue"),
        text.norm_doi(F.col("DOI")).alias("doi"), F.lit(None).cast("string").alias("arxiv"), F.array("type").alias("types"),
    )


_OPTIONAL = {"type": "string", "url": "string", "url_status": "int", "in_journal": "boolean", "unpublished": "boolean", "to_verify": "boolean"}
_RECORD = {"arxiv": "string", "volume": "string", "page": "string"}


def _with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def _looked_up(entries: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with ``path`` and the record of their DOI, and the records as they are compared."""
    entries, records = _with_missing(entries, _OPTIONAL), _with_missing(records, _RECORD)
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    page = F.coalesce(F.col("type").isin("misc", "online", "electronic"), F.lit(False)) & F.col("url").isNotNull() & ~known("in_journal")
    mine = entries.select(
        "entry", F.col("title").alias("b_title"), F.col("year").cast("string").alias("b_year"), F.col("venue").alias("b_venue"), text.norm_doi(F.col("doi")).alias("d"), text.spaced_title(F.coalesce("title", F.lit(""))).alias("lt"),
        page.alias("_page"), F.col("url").alias("_url"), url_alive(F.col("url_status")).alias("_alive"), known("unpublished").alias("_unpublished"), known("to_verify").alias("_to_verify"),
    )
    theirs = records.select(
        "record", "ord", text.norm_doi(F.col("doi")).alias("r_doi"), F.col("title").alias("r_title"), text.spaced_title(F.coalesce("title", F.lit(""))).alias("rt"), F.col("year").cast("string").alias("r_year"), "retracted",
        *[F.col(c).alias(f"r_{c}") for c in _RECORD],
    )
    by_doi = theirs.filter("r_doi is not null").groupBy("r_doi").agg(F.min_by("record", "ord").alias("doi_record")).withColumnRenamed("r_doi", "d")
    path = (
        F.when(F.col("d").isNotNull(), F.when(F.col("doi_record").isNotNull(), BY_DOI).otherwise("NOT-FOUND")).when(F.col("_page"), F.when(F.col("_alive"), "NON-PAPER-OK").otherwise("UNVERIFIABLE"))
        .when(F.coalesce(F.col("b_title"), F.lit("")) == "", "UNVERIFIABLE").otherwise(BY_TITLE)
    )
    return mine.join(by_doi, "d", "left").withColumn("path", path), theirs


def paths(entries: DataFrame, records: DataFrame) -> DataFrame:
    """``entry, path``: how ``audit`` looks up the record of each entry, or its verdict where no record decides it. No title is sought."""
    return _looked_up(entries, records)[0].select("entry", "path")


def audit(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Verdict of each entry against the records, with what differs, notes and suggested fields.

    ``entries``: ``entry, title, year, venue, doi``, ``records``: ``record, ord, title, year, venue, doi,
    retracted`` (null: unknown). With a DOI the record is looked up by it alone; else by the most alike title, from
    0.55 on. An entry is the same work by DOI, or with a likeness of 0.90 and years within 2 or unknown. Titles
    below 0.90 differ, below 0.80 the record's is suggested. Years 1 or 2 apart are a note, more differ. RETRACTED
    needs the same work, with a DOI on either side, and outranks what differs. A DOI that only the record has is a
    difference that keeps VERIFIED.

    ``entries`` may also have ``type``, ``url``, ``url_status``, ``in_journal``, ``unpublished`` and ``to_verify`` (see
    ``entry_fields``), ``records`` ``arxiv``, ``volume`` and ``page``. Without a DOI a misc, online or electronic entry
    with a link and no journal is NON-PAPER-OK if the link is alive, else UNVERIFIABLE; one without a title is
    UNVERIFIABLE; one that isn't found is UNVERIFIABLE if unpublished, else NOT-FOUND. Of records with equal DOIs or
    equally alike titles the first by ``ord`` counts.
    """
    first, theirs = _looked_up(entries, cut_lineage(records))  # read by DOI, by word and by title
    sought = first.filter((F.col("path") == BY_TITLE) & (F.col("lt") != ""))
    found = best_title(sought.select("entry", "lt"), theirs).withColumnsRenamed({"record": "title_record", "likeness": "_likeness"})
    joined = first.join(found, "entry", "left").withColumn("record", F.coalesce("doi_record", "title_record"))
    by_title = F.when(F.col("doi_record").isNull(), F.col("_likeness"))  # compared already
    full = joined.join(theirs.drop("ord"), "record", "left").withColumn("likeness", F.coalesce(by_title, title_likeness(F.when(by_title.isNull(), F.col("lt")), F.col("rt"))))

    there, by_id, gap, likeness = F.col("record").isNotNull(), F.col("d").isNotNull(), year_gap(F.col("b_year"), F.col("r_year")), F.col("likeness")
    same = there & (by_id | ((likeness >= 0.90) & F.coalesce(gap <= 2, F.lit(True))))
    titled = F.coalesce(F.col("r_title"), F.lit("")) != ""
    title_differs, title_conflicts = there & titled & (likeness < 0.90), there & titled & (likeness < 0.80)
    year_differs, doi_lacks = there & F.coalesce(gap > 2, F.lit(False)), same & ~by_id & F.col("r_doi").isNotNull()
    checked = F.coalesce(F.col("d"), F.when(same, F.col("r_doi"))).isNotNull() & there
    say = lambda condition, *parts: F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))
    year, r_year = F.col("b_year"), F.col("r_year")
    staged = full.withColumns({"_same": F.coalesce(same, F.lit(False)), "_checked": checked, "_retracted": checked & F.coalesce(F.col("retracted"), F.lit(False))})
    diffs = F.array_compact(F.array(F.when(title_differs, F.lit("title")), F.when(year_differs, F.lit("year")), F.when(doi_lacks, F.lit("doi"))))
    notes = F.array_compact(F.array(
        say(F.col("_retracted"), "retracted: don't cite it as support"), say(there & gap.between(1, 2), "year differs by ", gap, " (", year, " vs ", r_year, ")"), say(year_differs & ~by_id, "large year gap on a match by title alone: may be another edition"),
        say(there & venue_is_publisher(F.col("b_venue")), "'", F.col("b_venue"), "' is a publisher, not a journal"), say(there & F.col("_to_verify"), "carries a VERIFY note"),
        say(F.col("_checked") & F.col("retracted").isNull(), "retraction status could not be checked"), say(~there & by_id, "DOI is not known"), say(~by_id & F.col("_page"), "no paper; link ", F.when(F.col("_alive"), F.lit("resolves: ")).otherwise(F.lit("did not resolve: ")), F.col("_url")),
    ))
    suggest = F.array_compact(F.array(
        say(title_conflicts, "title = {", F.col("r_title"), "}"), say(there & by_id & gap.between(1, 2), "year = {", r_year, "}  % if you cite the published version"), say(year_differs & by_id, "year = {", r_year, "}"),
        say(doi_lacks, "doi = {", F.col("r_doi"), "}"), say(F.col("_same") & ~by_id & F.col("r_doi").isNull() & F.col("r_arxiv").isNotNull(), "eprint = {", F.col("r_arxiv"), "}  % arXiv"),
        say(there & F.col("_to_verify") & F.col("r_volume").isNotNull(), "volume = {", F.col("r_volume"), "}"), say(there & F.col("_to_verify") & F.col("r_page").isNotNull(), "pages = {", F.col("r_page"), "}"),
    ))
    verdict = (
        F.when(~F.col("path").isin(BY_DOI, BY_TITLE), F.col("path"))
        .when(~there, F.when(F.col("_unpublished"), "UNVERIFIABLE").otherwise("NOT-FOUND")).when(F.col("_retracted"), "RETRACTED").when(title_differs | year_differs, "MISMATCH").otherwise("VERIFIED")
    )
    return staged.select("entry", "record", verdict.alias("verdict"), F.round("likeness", 6).alias("likeness"), F.col("_same").alias("same_work"), diffs.alias("diffs"), notes.alias("notes"), suggest.alias("suggest"))


def verdict_counts(audited: DataFrame) -> DataFrame:
    order = F.array(*[F.lit(v) for v in ORDER])
    return audited.groupBy("verdict").agg(F.count(F.lit(1)).alias("entries")).withColumn("severity", F.array_position(order, F.col("verdict")).cast("int"))


# The citation commands whose arguments are keys, and what a paragraph with citations holds.
CITE = r"\\(?:cite|citep|citet|citealp|citeauthor|parencite|textcite|autocite)\*?(?:\[[^\]]*\])*\{([^}]+)\}"
CITING = ("\\cite", "cite{")


def cited_sentences(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``<key>, pos, sentence, cited``: one row per sentence and cited key, commands shown as ``[CITE]``.

    A key that a sentence cites twice has two rows. Only paragraphs that hold a text of ``CITING`` are read.
    """
    body = text.without_comments(text.body(F.col("text"), F.lit(False)))
    marks = F.array(*[F.lit(m) for m in CITING])
    lines = documents.select(key, F.posexplode(text.sentences(body, marks)).alias("pos", "raw")).filter(F.col("raw").rlike(CITE))
    keys = F.flatten(F.transform(F.regexp_extract_all("raw", F.lit(CITE), F.lit(1)), lambda k: F.split(k, ",")))
    out = lines.select(key, "pos", text.stripped(F.regexp_replace("raw", CITE, "[CITE]")).alias("sentence"), F.explode(F.transform(keys, text.stripped)).alias("cited"))
    return out.filter("cited <> ''")


def abstract_of(papers: DataFrame) -> DataFrame:
    """``papers`` with ``abstract_text`` and ``abstract_src``: own abstract, the second source's, the short one."""
    full = lambda c: F.nullif(text.stripped(c), F.lit(""))
    own, other, short = full(F.col("abstract")), full(F.col("_abstract_openalex")), full(F.col("tldr.text"))
    label = F.when(own.isNotNull(), "abstract").when(other.isNotNull(), "openalex").when(short.isNotNull(), "tldr")
    return papers.withColumn("abstract_text", F.coalesce(own, other, short)).withColumn("abstract_src", label)


def match_papers(bib: DataFrame, papers: DataFrame, least: float = 0.85) -> DataFrame:
    """``citekey, paperid, matched_by``: the paper of each entry, by DOI, else by the most alike of all titles; null without one.

    ``bib``: ``citekey, title, doi`` (the last of a key counts by ``ord``); ``papers``: ``paperid, title, doi, ord`` (the last
    of a DOI counts, the first of equally alike titles). Without a DOI that is known, an entry is compared with all papers.
    """
    papers = cut_lineage(papers.select("paperid", "title", "doi", "ord"))  # read by DOI and by title, several times
    entries = bib.groupBy("citekey").agg(F.max_by(F.struct("title", "doi"), "ord").alias("e")).select("citekey", F.trim(text.bare_title(F.col("e.title"))).alias("lt"), text.norm_doi(F.col("e.doi")).alias("d"))
    entries = cut_lineage(entries)
    keyed = papers.withColumn("d", text.norm_doi(F.col("doi")))
    by_doi = keyed.filter("d is not null").groupBy("d").agg(F.max_by("paperid", "ord").alias("doi_paper"))
    first = entries.join(by_doi, "d", "left")
    rest = first.filter("doi_paper is null and coalesce(lt, '') <> ''").select(F.col("citekey").alias("entry"), "lt")
    alike = best_title(rest, papers.select(F.col("paperid").alias("record"), "ord", F.trim(text.bare_title(F.col("title"))).alias("rt")), least, search=False)
    matched = first.join(alike.select(F.col("entry").alias("citekey"), F.col("record").alias("title_paper")), "citekey", "left")
    by = F.when(F.col("doi_paper").isNotNull(), "doi").when(F.col("title_paper").isNotNull(), "title")
    return matched.select("citekey", F.coalesce("doi_paper", "title_paper").alias("paperid"), by.alias("matched_by"))


def pair_citations(cited: DataFrame, bib: DataFrame, papers: DataFrame, least: float = 0.85) -> DataFrame:
    """``cited`` with ``status``, ``matched_by``, ``paperid`` and the abstract of the paper that ``match_papers`` finds.

    Entries that nobody cites are in no row, so they are not matched.
    ``papers`` also has ``abstract_text, abstract_src``; the last of a ``paperid`` by ``ord`` counts.
    """
    asked = bib.join(cited.select(F.col("cited").alias("citekey")).distinct(), "citekey", "left_semi")
    matched = match_papers(asked, papers, least).withColumn("_entry", F.lit(True))
    texts = papers.groupBy("paperid").agg(F.max_by(F.struct("abstract_text", "abstract_src"), "ord").alias("a")).select("paperid", "a.*")
    joined = cited.join(matched, cited["cited"] == matched["citekey"], "left").join(texts, "paperid", "left")
    status = F.when(F.col("_entry").isNull(), NO_ENTRY).when(F.col("paperid").isNull(), NOT_IN_STORE).when(F.col("abstract_text").isNull(), NO_ABSTRACT).otherwise(PAIRED)
    return joined.select(*cited.columns, status.alias("status"), "matched_by", "paperid", "abstract_text", "abstract_src")


def worksheet(paired: DataFrame, bib: DataFrame, shown: int | None = 1200) -> DataFrame:
    """``citekey, title, status, matched_by, claims, abstract_src, abstract``: what is to be judged of each cited key.

    ``paired`` is ``pair_citations``, whose status is the same for all rows of a key. ``claims`` counts the sentences; the
    sentences themselves stay rows of ``paired``, as a key may be cited any number of times. ``shown`` is the number of characters of the
    abstract that are shown, None for the whole of it.
    """
    titles = bib.groupBy("citekey").agg(F.max_by("title", "ord").alias("title"))
    keys = paired.groupBy(F.col("cited").alias("citekey")).agg(
        F.min("status").alias("status"), F.min("matched_by").alias("matched_by"), F.count(F.lit(1)).alias("claims"), F.min("abstract_src").alias("abstract_src"), F.min("abstract_text").alias("_text")
    )
    return keys.join(titles, "citekey", "left").select("citekey", "title", "status", "matched_by", "claims", "abstract_src", (F.col("_text") if shown is None else F.substring("_text", 1, shown)).alias("abstract"))


def worksheet_counts(paired: DataFrame) -> DataFrame:
    """``status, instances, keys`` of a worksheet, statuses without any included."""
    every = paired.sparkSession.createDataFrame([(s,) for s in (PAIRED, NO_ABSTRACT, NOT_IN_STORE, NO_ENTRY)], "status string")
    found = paired.groupBy("status").agg(F.count(F.lit(1)).alias("instances"), F.count_distinct("cited").alias("keys"))
    return every.join(found, "status", "left").na.fill(0, ["instances", "keys"])


def missing_keys(cited: DataFrame, bib: DataFrame) -> DataFrame:
    """``cited, times``: cited keys that the bibliography lacks, which is an error."""
    return cited.join(bib.select(F.col("citekey").alias("cited")), "cited", "left_anti").groupBy("cited").agg(F.count(F.lit(1)).alias("times"))
