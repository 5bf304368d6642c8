"""Files as tables: result files, texts, CSV, fingerprints of any file, JSON lines, unified diffs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "struct<rmse:double,mae:double,mape:double,params:bigint,futility_stop:string>"
#: A result file; ``_corrupt_record`` holds what can't be read.
RUN = f"notebook string, seed bigint, smoke_test boolean, span_start string, timestamp_utc string, results map<string,{RECORD}>, _corrupt_record string"
LOG = "id bigint, ts string, session string, track string, type string, text string, evidence array<string>, refs array<bigint>, _corrupt_record string"


def result_files(spark: SparkSession, paths: str) -> DataFrame:
    """Result files with ``path`` and ``parse_error``; unreadable ones are rows too. Declared schema, one scan."""
    return parse_runs(spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value"))


def readable_runs(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("parse_error")).drop("parse_error")


def texts(spark: SparkSession, paths: str) -> DataFrame:
    """``path, text`` of whole files."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with its header; cells stay texts, as profiles expect. Short rows have nulls."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON-lines log; blank lines are passed over and damaged ones left out."""
    raw = spark.read.schema(LOG).json(path)
    return raw.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop("_corrupt_record")


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def parse_runs(texts: DataFrame, column: str = "value") -> DataFrame:
    """Result JSON of a text column as the columns of ``RUN``, with ``parse_error``; other columns are kept."""
    others = [c for c in texts.columns if c != column]
    parsed = texts.select(*others, F.from_json(column, RUN, {"mode": "PERMISSIVE"}).alias("_r"))
    flat = parsed.select(*others, *[F.col(f"_r.{f.name}").alias(f.name) for f in parsed.schema["_r"].dataType.fields if f.name not in others])
    return flat.withColumn("parse_error", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def _listed(spark: SparkSession, folder: str, pattern: str, recursive: bool) -> DataFrame:
    """``path, bytes, modified`` of files, empty ones too, whose content isn't read; about one file to a task, as sizes differ."""
    from fnmatch import fnmatchcase

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    head = folder[: folder.find(root)] if root in folder else ""
    found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=recursive)) if i.type == fs.FileType.File and fnmatchcase(i.base_name, pattern)]
    rows = spark.createDataFrame([(head + i.path, i.size, i.mtime) for i in found], "path string, bytes bigint, modified timestamp")
    return rows.repartition(spark.sparkContext.defaultParallelism * 4, "path")


def _opened(path: str):
    """A stream over a file of any file system that pyarrow knows; it is never held whole."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_stream(name)


def fingerprints(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``path, bytes, modified, sha256, format`` of the files of a folder. Files of any size are hashed in pieces where they are read.

    ``format`` is the extension in small letters, ``raw`` without one; ``csv_fingerprints`` and ``npy_profile`` say more of two of them.
    """
    import hashlib

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = []
            for path in batch["path"]:
                mark = hashlib.sha256()
                with _opened(path) as stream:
                    while piece := stream.read(1 << 20):
                        mark.update(piece)
                marks.append(mark.hexdigest())
            yield batch.assign(sha256=marks)

    hashed = _listed(spark, folder, pattern, recursive).mapInPandas(read, "path string, bytes bigint, modified timestamp, sha256 string")
    return hashed.withColumn("format", F.coalesce(F.nullif(F.lower(F.regexp_extract("path", r"[^/.][^/]*\.([^./]+)$", 1)), F.lit("")), F.lit("raw")))


#: Distinct values of a column of a CSV file that are kept; beyond it their number is null. Rows that are taken at once.
MAX_DISTINCT, ROWS_AT_ONCE = 1000, 20_000


class _Column:
    """What a stream of a column's cells shows: missing and distinct values, bounds, and a hash in the order of the file."""

    def __init__(self, missing: tuple[str, ...]) -> None:
        import hashlib

        self.missing, self.mark = missing, hashlib.sha256()
        self.rows, self.nulls, self.distinct, self.low, self.high = 0, 0, set(), None, None

    def add(self, cells: list[str]) -> None:
        self.rows += len(cells)
        self.mark.update("".join(c + "\x1f" for c in cells).encode("utf-8", "replace"))
        filled = [c for c in cells if c.lower() not in self.missing]
        self.nulls += len(cells) - len(filled)
        if self.distinct is not None:
            self.distinct |= set(filled)
            self.distinct = None if len(self.distinct) > MAX_DISTINCT else self.distinct
        for c in set(filled):
            try:
                x = float(c)
            except ValueError:
                continue
            if x == x:
                self.low, self.high = (x, x) if self.low is None else (min(self.low, x), max(self.high, x))

    def row(self) -> tuple:
        return self.rows, self.nulls, None if self.distinct is None else len(self.distinct), self.low, self.high, self.mark.hexdigest()[:16]


def csv_fingerprints(spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = True) -> DataFrame:
    """``path`` and the columns of ``profile.profile`` for each CSV file, each read as a stream by one task.

    ``col_hash`` depends on the order of the rows of the file. Cells are stripped, short rows have empty ones, cells beyond the
    header are left out. A file without a header has no row.
    """
    from attestra.operators.profile import MISSING

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv as reader
        import io

        for batch in batches:
            for path in batch["path"]:
                with _opened(path) as stream:
                    rows = reader.reader(io.TextIOWrapper(io.BufferedReader(stream), "utf-8", errors="replace", newline=""))
                    names = next(rows, None)
                    if names is None:
                        continue
                    columns = [_Column(MISSING) for _ in names]
                    while chunk := [row for _, row in zip(range(ROWS_AT_ONCE), rows)]:
                        for i, column in enumerate(columns):
                            column.add([row[i].strip() if i < len(row) else "" for row in chunk])
                found = [(path, name, i, *column.row()) for i, (name, column) in enumerate(zip(names, columns))]
                yield pd.DataFrame(found, columns=["path", "column", "place", "rows", "nulls", "distinct", "min", "max", "col_hash"]).astype({"distinct": "Int32"})

    return _listed(spark, folder, pattern, recursive).select("path").mapInPandas(read, "path string, column string, place int, rows bigint, nulls bigint, distinct int, min double, max double, col_hash string")


def is_pdf(content: F.Column, length: F.Column, least: int = 10_000) -> F.Column:
    """Does a download look like a whole PDF: its mark in the first KiB and a size that is no error page?"""
    return (length >= least) & (F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF") > 0)


def diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line`` of one diff file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def npy_profile(spark: SparkSession, folder: str) -> DataFrame:
    """``path, shape, dtype, nans, min, max, constant`` of ``.npy`` files; unreadable ones have nulls."""
    import io

    import numpy as np

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                except ValueError:
                    rows.append((path, None, None, None, None, None, None))
                    continue
                numeric = a.size and np.issubdtype(a.dtype, np.number) and not np.issubdtype(a.dtype, np.complexfloating)
                good = a[~np.isnan(a)] if numeric and np.issubdtype(a.dtype, np.floating) else a
                low, high = (float(good.min()), float(good.max())) if numeric and good.size else (None, None)
                rows.append((path, list(a.shape), str(a.dtype), int(a.size - good.size) if numeric else 0, low, high, low is not None and low == high))
            yield pd.DataFrame(rows, columns=["path", "shape", "dtype", "nans", "min", "max", "constant"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInPandas(read, "path string, shape array<bigint>, dtype string, nans bigint, min double, max double, constant boolean")
