"""BibTeX as rows. Balanced braces are not regular, so entries are read in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What begins an entry and a field, and the kinds that are no entries.
ENTRY, FIELD = re.compile(r"@(\w+)\s*\{"), re.compile(r"[ \t\r\n,]*(\w+)\s*=\s*")
SKIPPED = ("comment", "preamble", "string")
_BRACE, _BARE = re.compile(r"[{}]"), re.compile(r"[,\n]")


def _closing(text: str, at: int) -> int:
    """Place of the brace that closes the group whose inside begins at ``at``; where none does, that of the last character."""
    depth = 1
    for brace in _BRACE.finditer(text, at):
        depth += 1 if brace.group() == "{" else -1
        if depth == 0:
            return brace.start()
    return max(at, len(text) - 1)


def _fields(body: str) -> dict[str, str]:
    """Braced, quoted and bare values; names in lower case, the last of a name counts.

    What is no field ends the entry. Quotes end at the next one, bare values at a comma or line end.
    """
    out: dict[str, str] = {}
    at = 0
    while (found := FIELD.match(body, at)) and found.end() < len(body):
        at = found.end()
        if body[at] == "{":
            end = _closing(body, at + 1)
            value, at = body[at + 1 : end], end + 1
        elif body[at] == '"':
            end = body.find('"', at + 1)
            end = len(body) if end < 0 else end
            value, at = body[at + 1 : end], end + 1
        else:
            stop = _BARE.search(body, at)
            end = stop.start() if stop else len(body)
            value, at = body[at:end], end
        out[found.group(1).lower()] = " ".join(value.split())
    return out


def entries(text: str | None) -> list[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of every entry; comments, preambles and strings are passed over, entries inside entries are not."""
    out = []
    for found in ENTRY.finditer(text or ""):
        kind = found.group(1).lower()
        if kind not in SKIPPED:
            key, _, rest = text[found.end() : _closing(text, found.end())].partition(",")
            out.append((kind, key.strip(), _fields(rest)))
    return out


def parse(texts: DataFrame, column: str = "text", key: str = "path") -> DataFrame:
    """``<key>, pos, type, citekey, fields``: every entry of every text. Null and empty texts have none."""
    key_type = texts.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *e) for k, text in zip(batch[key], batch[column]) for i, e in enumerate(entries(text))]
            yield pd.DataFrame(rows, columns=[key, "pos", "type", "citekey", "fields"])

    return texts.select(key, column).mapInPandas(read, f"{key} {key_type}, pos int, type string, citekey string, fields map<string,string>")


def read(spark: SparkSession, paths: str) -> DataFrame:
    """Entries of BibTeX files, one file a row group; ``path`` says where each comes from."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return parse(files)
