"""Views over an append-only log of entries, and the check of a narrative against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.running import numbered

# Statuses of a track, their order in a digest, types of entries, and the type that gives the reason of a status.
STATUSES = ("pending", "active", "blocked", "done", "dropped")
DIGEST_ORDER = ("active", "blocked", "pending", "done", "dropped")
TYPES = ("progress", "finding", "blocker", "decision", "correction", "next", "status")
REASON = {"blocked": "blocker", "dropped": "decision"}
TAGS = {"progress": "[prog]", "finding": "[FIND]", "blocker": "[BLKR]", "decision": "[decn]", "correction": "[corr]", "next": "[next]", "status": "[stat]"}


def latest(entries: DataFrame, kind: str | None = None) -> DataFrame:
    """The last entry of each track, by ``id``, of one type or any."""
    own = entries if kind is None else entries.filter(F.col("type") == kind)
    others = [c for c in entries.columns if c != "track"]
    return own.groupBy("track").agg(F.max_by(F.struct(*others), "id").alias("e")).select("track", "e.*")


def superseded(entries: DataFrame) -> DataFrame:
    """``id, by``: entries that corrections refer to, with the ids of these in order."""
    refs = entries.filter("type = 'correction'").select(F.col("id").alias("by"), F.explode("refs").alias("id"))
    return refs.groupBy("id").agg(F.array_sort(F.collect_set("by")).alias("by"))


def digest(tracks: DataFrame, entries: DataFrame) -> DataFrame:
    """``track, status, blocker, next_step, stale``: tracks in order of status, then id.

    ``place`` is the place of the status in a digest from 0, 9 for others. The next step is the last ``next`` of a track that is not done or dropped (tracks that are not
    registered count as going on); it is stale where a later entry of the track exists.
    """
    last, nxt, block = latest(entries), latest(entries, "next"), latest(entries, "blocker")
    known = tracks.select(F.col("id").alias("track"), "status")
    all_tracks = known.join(last.select("track", F.col("id").alias("last_id")), "track", "full_outer")
    steps = all_tracks.join(nxt.select("track", F.col("id").alias("next_id"), F.col("text").alias("next_text")), "track", "left").join(block.select("track", F.col("text").alias("block_text")), "track", "left")
    going = ~F.coalesce(F.col("status"), F.lit("")).isin("done", "dropped")
    place = F.array_position(F.array(*[F.lit(s) for s in DIGEST_ORDER]), F.coalesce("status", F.lit("")))
    return steps.select(
        "track", "status", F.when(place == 0, 9).otherwise(place - 1).cast("int").alias("place"), F.when(F.col("status") == "blocked", F.col("block_text")).alias("blocker"),
        F.when(going, F.col("next_text")).alias("next_step"), F.coalesce(going & (F.col("last_id") > F.col("next_id")), F.lit(False)).alias("stale"),
    )


def chronology(entries: DataFrame) -> DataFrame:
    """``track, id, value``: each entry as a line of the compiled log, with what supersedes it, its refs and its evidence.

    In order of ``track`` and ``id`` the lines are the log. Corrections of an entry are named in order of their ids.
    """
    tag = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair]), F.col("type")), F.lit("[????]"))
    some = lambda c, head, each, tail: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(head), F.array_join(F.transform(c, each), ", "), F.lit(tail))).otherwise(F.lit(""))
    number = lambda x: F.concat(F.lit("#"), x.cast("string"))
    both = entries.join(superseded(entries), "id", "left")
    line = F.concat(
        F.lit("- **#"), F.col("id").cast("string"), F.lit("** "), F.coalesce("session", F.lit("")), F.lit(" "), tag, F.lit(" "), F.coalesce("text", F.lit("")), some(F.col("by"), " **[superseded by ", number, "]**"), some(F.col("refs"), " (re: ", number, ")"),
        some(F.col("evidence"), "  \n  evidence: ", lambda e: F.concat(F.lit("`"), e, F.lit("`")), ""),
    )
    return both.select("track", "id", line.alias("value"))


def sessions(entries: DataFrame) -> DataFrame:
    return entries.groupBy("session").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("track").alias("tracks"))


def track_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("track").agg(F.count(F.lit(1)).alias("entries"), F.max("session").alias("last_session"))


def warnings(entries: DataFrame, tracks: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """``id, warning``: findings without evidence, corrections without refs, refs that no entry has, unknown types.

    With ``tracks`` (``id``) entries of unknown tracks, with ``files`` (``path``) evidence that is no file are named too.
    """
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    own = entries.select("id", F.explode(F.array_compact(F.array(
        F.when((F.col("type") == "finding") & empty("evidence"), "finding without evidence"), F.when((F.col("type") == "correction") & empty("refs"), "correction without refs"),
        F.when(~F.col("type").isin(*TYPES), "unknown type"),
    ))).alias("warning"))
    refs = entries.select("id", F.explode("refs").alias("ref"))
    out = own.unionByName(refs.join(entries.select(F.col("id").alias("ref")), "ref", "left_anti").select("id", F.concat(F.lit("unknown ref #"), "ref").alias("warning")))
    if tracks is not None:
        out = out.unionByName(entries.join(tracks.select(F.col("id").alias("track")), "track", "left_anti").select("id", F.concat(F.lit("unknown track "), F.coalesce("track", F.lit("?"))).alias("warning")))
    if files is not None:
        shown = entries.select("id", F.explode("evidence").alias("path"))
        out = out.unionByName(shown.join(files.select("path"), "path", "left_anti").select("id", F.concat(F.lit("no file "), "path").alias("warning")))
    return out


def append(entries: DataFrame, additions: DataFrame) -> DataFrame:
    """Additions (``ord`` and the fields) with ids that go on after the last entry's; a single writer is assumed.

    ``ord`` must be unique; additions are range-partitioned by it, so any number of them is numbered.
    """
    top = F.broadcast(entries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")))  # a single row
    placed = numbered(additions, ["ord"], "_place")
    return placed.crossJoin(top).withColumn("id", (F.col("_top") + F.col("_place")).cast("bigint")).drop("_top", "_place", "ord")


def init(spark: SparkSession, name: str, plan: str = "", created: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """An empty log: one row of metadata, the registry of tracks and the entries."""
    meta = spark.createDataFrame([(name, plan, created)], "investigation string, plan string, created string")
    return meta, spark.createDataFrame([], TRACK), spark.createDataFrame([], ENTRY)


#: A track and an entry of a log.
TRACK = "id string, title string, status string, depends_on array<string>"
ENTRY = "id bigint, ts string, session string, track string, type string, text string, evidence array<string>, refs array<bigint>"


def add_tracks(tracks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry with the new tracks, and ``id, problem`` of those that are refused or doubtful.

    ``wanted``: ``id, title, depends, status`` (``depends`` parted by commas; a null status is ``pending``). A track that
    is there, or a status that isn't one, is refused. A dependency that is no track, old or new, is doubtful only.
    """
    parts = F.filter(F.transform(F.split(F.coalesce("depends", F.lit("")), ","), lambda d: F.trim(d)), lambda d: d != "")
    asked = wanted.select("id", "title", F.coalesce("status", F.lit("pending")).alias("status"), parts.alias("depends_on"))
    known = tracks.select("id", F.lit(True).alias("_there"))
    judged = asked.join(known, "id", "left").withColumn("problem", F.when(F.col("_there"), "exists").when(~F.col("status").isin(*STATUSES), "no status"))
    fresh = judged.filter("problem is null").select("id", "title", "status", "depends_on")
    every = tracks.select("id").unionByName(fresh.select("id"))
    loose = fresh.select("id", F.explode("depends_on").alias("_d")).join(every.select(F.col("id").alias("_d")), "_d", "left_anti").select("id", F.concat(F.lit("unknown dependency "), "_d").alias("problem"))
    return tracks.unionByName(fresh), judged.filter("problem is not null").select("id", "problem").unionByName(loose)


def status_changes(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries that setting a status appends: ``status`` itself, and ``blocker`` or ``decision`` with a note.

    ``wanted``: ``track, status, note``. Statuses that aren't ones and unknown tracks append nothing; one that
    stays as it is is logged too. An empty note is none.
    """
    both = wanted.alias("w").join(tracks.alias("t"), F.col("w.track") == F.col("t.id")).filter(F.col("w.status").isin(*STATUSES))
    note = F.nullif(F.col("w.note"), F.lit(""))
    said = F.concat(F.lit("status "), F.coalesce("t.status", F.lit("None")), F.lit(" -> "), "w.status", F.coalesce(F.concat(F.lit(": "), note), F.lit("")))
    reasons = [F.when(note.isNotNull() & (F.col("w.status") == s), F.struct(F.lit(2).alias("place"), F.lit(k).alias("type"), note.alias("text"))) for s, k in REASON.items()]
    rows = F.array_compact(F.array(F.struct(F.lit(1).alias("place"), F.lit("status").alias("type"), said.alias("text")), *reasons))
    return both.select(F.col("w.track").alias("track"), F.inline(rows))


def set_status(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The registry with the wanted statuses (``track, status``); the last of ``wanted`` by status text counts on repeats."""
    new = wanted.filter(F.col("status").isin(*STATUSES)).groupBy(F.col("track").alias("id")).agg(F.max("status").alias("_new"))
    return tracks.join(new, "id", "left").select(*[F.coalesce("_new", "status").alias("status") if c == "status" else F.col(c) for c in tracks.columns])


def check_narrative(narratives: DataFrame, entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """``<key>, severity, ref, problem``: unknown ids FAIL, superseded ones warn, a text without any FAILs."""
    cites = narratives.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"#(\d+)\b"), F.lit(1)))).alias("r")).select(key, F.col("r").try_cast("bigint").alias("ref"))
    ids, old = entries.select(F.col("id").alias("ref")), superseded(entries).select(F.col("id").alias("ref"))
    unknown = cites.join(ids, "ref", "left_anti").select(key, F.lit("FAIL").alias("severity"), "ref", F.lit("unknown").alias("problem"))
    stale = cites.join(old, "ref", "left_semi").select(key, F.lit("warn").alias("severity"), "ref", F.lit("superseded").alias("problem"))
    silent = narratives.join(cites.select(key).distinct(), key, "left_anti").select(key, F.lit("FAIL").alias("severity"), F.lit(None).cast("bigint").alias("ref"), F.lit("no citation").alias("problem"))
    return unknown.unionByName(stale).unionByName(silent)


def uncited_findings(narratives: DataFrame, entries: DataFrame) -> DataFrame:
    """``id`` of findings that no narrative cites and no correction supersedes."""
    cites = narratives.select(F.explode(F.regexp_extract_all("text", F.lit(r"#(\d+)\b"), F.lit(1))).alias("r")).select(F.col("r").try_cast("bigint").alias("id")).distinct()
    return entries.filter("type = 'finding'").select("id").join(cites, "id", "left_anti").join(superseded(entries).select("id"), "id", "left_anti")
