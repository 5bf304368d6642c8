"""Fields of papers whose text looks like ordinary text but consists of other characters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.unicode_forms import canonical

#: Characters that are stable whatever stands beside them, as a class for Java's expressions:
#: ASCII, composed Latin letters, common typographic marks, Arabic, kana, Han and Hangul syllables.
STABLE = r"\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u0131\u0134-\u01c3\u01f4-\u021f\u0226-\u024f\u1ea0-\u1ef9\u2013-\u201d\u2026\u060c\u061b\u061f\u0620-\u063f\u0641-\u064a\u0660-\u0669\u066e\u066f\u0671-\u06d3\u06f0-\u06fc\u3001-\u301f\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fff\uac00-\ud7a3"


def unstable(text: Column) -> Column:
    """Does the text have a character that isn't stable by itself? Null gives false."""
    return F.coalesce(text.rlike(f"[^{STABLE}]"), F.lit(False))


def _names(authors: Column) -> Column:
    return F.transform(authors, lambda a: a["name"])


def _findings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            if row.title is not None and (fixed := canonical(row.title)) != row.title:
                rows.append((row.row_id, "title", [row.title], [fixed]))
            if row.names is not None:
                names = list(row.names)
                context = " ".join(n for n in names if n)
                fixed_names = [canonical(n, context, symbols=False) for n in names]
                if fixed_names != names:
                    rows.append((row.row_id, "authors", names, fixed_names))
        yield pd.DataFrame(rows, columns=["row_id", "field", "stored", "canonical"])


def findings(papers: DataFrame) -> DataFrame:
    """``row_id, field, stored, canonical`` for each row and field (title, authors) that changes.

    ``stored`` and ``canonical`` are arrays: one text for a title, all names for authors. Only rows
    with an unstable character leave the JVM. Null titles, null author lists, null names and empty
    texts never count. Rows stored twice are found twice; an empty table gives an empty result.
    """
    own = papers.select("row_id", "title", _names(F.col("authors")).alias("names"))
    unstable_name = F.coalesce(F.exists("names", unstable), F.lit(False))
    suspects = own.select(
        "row_id",
        F.when(unstable(F.col("title")), F.col("title")).alias("title"),
        F.when(unstable_name, F.col("names")).alias("names"),
    ).filter(F.col("title").isNotNull() | F.col("names").isNotNull())
    return suspects.mapInPandas(_findings, "row_id bigint, field string, stored array<string>, canonical array<string>")


def canonical_fields(papers: DataFrame) -> DataFrame:
    """``row_id, title, authors`` (names) of every row in canonical form.

    Stable rows are passed on as they are; unstable ones go through Python. The two scans read the
    three columns only, which costs less than sending every row to Python.
    """
    own = papers.select("row_id", "title", _names(F.col("authors")).alias("authors"))
    either = unstable(F.col("title")) | F.coalesce(F.exists("authors", unstable), F.lit(False))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            titles = [canonical(t) for t in batch["title"]]
            authors = []
            for names in batch["authors"]:
                context = None if names is None else " ".join(n for n in names if n)
                authors.append(None if names is None else [canonical(n, context, symbols=False) for n in names])
            yield pd.DataFrame({"row_id": batch["row_id"], "title": pd.Series(titles, dtype=object), "authors": pd.Series(authors, dtype=object)})

    fixed = own.filter(either).mapInPandas(fix, "row_id bigint, title string, authors array<string>")
    return own.filter(~either).unionByName(fixed)
