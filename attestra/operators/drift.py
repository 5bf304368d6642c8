"""Schemas that drift between files: report of every change, and one table over all files.

A file is reduced to its schema tree where it is read. Files are then range-partitioned by
notebook and time, so a notebook that holds a third of all files spans as many partitions as it
needs. In each partition a stretch of files shrinks to those that the history can depend on; only these
meet in one place per notebook, so that group grows with the names and the changes and not with the files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import schema_trees as trees

_SHAPES = "notebook string, written_at timestamp, file_id bigint, shape string"


class _Stretch:
    """Of a stretch of files of one notebook, those that its history can depend on.

    These are the first file; the first file of each name and of each pair of names; the last file of each name and the
    one after it; changes of type or level with the file before; and, wherever a name begins or returns while another one
    that it never stands beside may have taken its place, the last values of the names that aren't there. Files in
    which optional fields merely come and go aren't among them, so their number is bounded by the names and the
    changes and not by the files.
    """

    def __init__(self) -> None:
        self.kept: dict[int, tuple] = {}
        self.at = 0
        self.last: dict[str, tuple] = {}
        self.after: dict[str, tuple | None] = {}
        self.valued: dict[str, tuple] = {}
        self.types: dict[str, list[str]] = {}
        self.levels: dict[str, int] = {}
        self.awaited: set[str] = set()
        self.beside: dict[str, set[str]] = {}
        self.combinations: set[frozenset[str]] = set()

    def keep(self, *files: tuple | None) -> None:
        self.kept |= {f[0]: f for f in files if f}

    def add(self, row: tuple, shape: dict[str, dict]) -> None:
        file = (self.at, *row, shape)
        self.at += 1
        names = frozenset(shape)
        fresh = [n for n in names if n not in self.last]
        returned = [n for n in names if self.after.get(n)]
        if names not in self.combinations:
            self.combinations.add(names)
            for n in names:
                if not names <= self.beside.setdefault(n, {n}):
                    self.beside[n] |= names
                    self.keep(file)
        # A name that never stood beside one that came since may be its other name.
        turned = [n for n in returned if any(m not in self.beside[n] and self.last[m][0] > self.last[n][0] for m in self.last)]
        if fresh or turned:
            self.keep(file, *(f for n in self.last if n not in names for f in (self.last[n], self.after[n], self.valued.get(n))))
            self.keep(*(self.last[n] for n in turned), *(self.after[n] for n in turned))
            self.awaited |= {n for n in (*fresh, *turned) if not shape[n]["t"]}
        for n, e in shape.items():
            if self.levels.get(n, e["s"]) != e["s"]:
                self.keep(self.last[n], file)
            self.levels[n] = e["s"]
            if e["t"]:
                if n in self.types and self.types[n] != e["t"]:
                    self.keep(self.valued[n], file)
                if n in self.awaited or n not in self.types:
                    self.awaited.discard(n)
                    self.keep(file)
                self.types[n], self.valued[n] = e["t"], file
        for n in self.last:
            if n not in names and self.after[n] is None:
                self.after[n] = file
        self.last |= dict.fromkeys(names, file)
        self.after |= dict.fromkeys(names)
        if file[0] == 0:
            self.keep(file)
        self.end = file

    def result(self) -> list[tuple]:
        """Rows of ``notebook, written_at, file_id, shape`` in order."""
        self.keep(self.end, *self.last.values(), *self.after.values(), *self.valued.values())
        return [self.kept[i][1:] for i in sorted(self.kept)]


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The files of each stretch that count; a partition holds one stretch of each of its notebooks."""
    notebook, stretch = None, None
    frame = lambda s: pd.DataFrame([(n, w, f, json.dumps(x)) for n, w, f, x in s.result()], columns=["notebook", "written_at", "file_id", "shape"])
    for batch in batches:
        for row in batch.itertuples(index=False):
            document = trees.parsed(row.body)
            if document is None:
                continue
            if stretch is None or row.notebook != notebook:
                if stretch is not None:
                    yield frame(stretch)
                notebook, stretch = row.notebook, _Stretch()
            stretch.add((row.notebook, row.written_at, row.file_id), trees.shape_of(document))
    if stretch is not None:
        yield frame(stretch)


def _reduced(files: DataFrame) -> DataFrame:
    own = files.select("notebook", F.col("written_at").cast("timestamp").alias("written_at"), "file_id", "body").filter(F.col("notebook").isNotNull())
    ordered = own.repartitionByRange("notebook", "written_at", "file_id").sortWithinPartitions("notebook", "written_at", "file_id")
    return ordered.mapInPandas(_summaries, _SHAPES)


def _histories(files: DataFrame, rows_of: Callable[[str, list, dict], list[tuple]], schema: str) -> DataFrame:
    """``rows_of(notebook, changes, names)`` of every notebook: its changes, and for each name the first name of its quantity.

    Notebooks follow each other in sorted partitions, so one call serves many of them and only the files that count of one
    notebook are held at once.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        notebook, sequence, found = None, {}, []
        done = lambda: rows_of(notebook, *trees.history_of(list(sequence.items()))) if sequence else []
        for batch in batches:
            for name, file, shape in zip(batch["notebook"], batch["file_id"], batch["shape"]):
                if name != notebook:
                    found += done()
                    notebook, sequence = name, {}
                sequence.setdefault(int(file), json.loads(shape))  # a file that is stored twice counts once
            yield pd.DataFrame(found, columns=columns)
            found = []
        yield pd.DataFrame(done(), columns=columns)

    order = ["notebook", F.col("written_at").asc_nulls_first(), "file_id"]
    return _reduced(files).repartition("notebook").sortWithinPartitions(*order).mapInPandas(read, schema)


def schema_changes(files: DataFrame) -> DataFrame:
    """``notebook, file_id, field, change_kind, renamed_to, type_before, type_after``, one row per change.

    The readable bodies of a notebook, ordered by ``written_at`` (null first), then ``file_id``, are
    a sequence; ``added``, ``removed``, ``renamed``, ``retyped`` and ``moved`` (to the other level, under the same or
    another name) are read off the cheapest edit scripts between its schema trees. Unreadable, empty and null bodies and bodies that are no JSON
    object are left out; so are rows without a notebook. A file stored twice counts once. An empty
    table and a notebook with one file give no rows; further columns are ignored.
    """

    def rows(notebook: str, changes: list, _: dict) -> list[tuple]:
        return [(notebook, file, field, kind, other or None, old or None, new or None) for file, field, kind, other, old, new in changes]

    return _histories(files, rows, "notebook string, file_id bigint, field string, change_kind string, renamed_to string, type_before string, type_after string")


def projections(files: DataFrame) -> DataFrame:
    """``notebook, names``: for each notebook the map from every name to its quantity's first name."""
    return _histories(files, lambda notebook, _, names: [(notebook, json.dumps(names))], "notebook string, names string")


_RUN_FIELDS = ("seed", "smoke_test", "span_start", "timestamp_utc")
_METRICS = ("rmse", "mae", "mape")


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, sort_keys=True)


def _whole(value: object) -> int | None:
    number = trees._number(value if not isinstance(value, dict) else next((v for v in value.values() if trees._number(v) is not None), None))
    return None if number is None else int(number)


def _truth(value: object) -> bool | None:
    if isinstance(value, str):
        return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(value.strip().lower())
    return bool(value) if isinstance(value, (bool, int, float)) else None


def _projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file_id", "notebook", "seed", "smoke_test", "span_start", "timestamp_utc", "config", "rmse", "mae", "mape", "params", "futility_stop", "other"]
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            document = trees.parsed(row.body)
            if document is None:
                continue
            names = json.loads(row.names) if isinstance(row.names, str) else {}
            container, records = trees.container_of(document)
            top = {names.get(k, k): v for k, v in document.items() if k != container}
            run = [row.file_id, row.notebook, _whole(top.get("seed")), _truth(top.get("smoke_test")), _text(top.get("span_start")), _text(top.get("timestamp_utc"))]
            more = {k: _text(v) for k, v in top.items() if k not in (*_RUN_FIELDS, "notebook")}
            for label, fields in records or [(None, {})]:
                own = {names.get(k, k): v for k, v in fields.items()}
                metrics = [trees._number(own.get(m)) for m in _METRICS]
                other = more | {k: _text(v) for k, v in own.items() if k not in (*_METRICS, "params", "futility_stop")}
                rows.append((*run, label, *metrics, _whole(own.get("params")), _text(own.get("futility_stop")), other))
        frame = pd.DataFrame(rows, columns=columns)
        yield frame.astype({"seed": "Int64", "params": "Int64", "smoke_test": "boolean"}) if rows else frame


def unified_runs(files: DataFrame) -> DataFrame:
    """One consistent row for each configuration of each readable file (one without, for files that have none).

    The names of each notebook are mapped by its own edit scripts, values of another type are brought
    to the column's type (a text that is no number is null there), ``other`` holds what has no column
    of its own, as text. NaN is null. Notebooks of any size are joined with one row of names each.
    """
    named = files.join(projections(files), "notebook", "left").select("file_id", "notebook", "body", "names")
    schema = (
        "file_id bigint, notebook string, seed bigint, smoke_test boolean, span_start string, timestamp_utc string, config string, "
        "rmse double, mae double, mape double, params bigint, futility_stop string, other map<string,string>"
    )
    return named.mapInPandas(_projected, schema)
