"""Exports as a Spark data source: text files with a header, all or nothing.

    spark.dataSource.register(Export)
    newest_first.write.format("export").option("path", url).option("limit", "250000").mode("append").save()

Each task writes one file into a folder of the job; the commit counts all rows and only then gives the files their names. With more rows than ``limit``, or if a task
fails, nothing is left. Files follow the order of partitions, so an ordered DataFrame (``orderBy`` deals it out by ranges) gives files that are in order one after the other.

Options: ``path`` (a folder's url, must be new); ``kind`` (``tsv``: tabs and line ends in values become blanks; ``csv``: values are quoted where needed and safe for spreadsheets);
``limit`` (none); ``header`` (true): a first line of names in each file, with a byte order mark; ``labels``: the names, comma-joined.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from traceloom.operators.read import newest_first
from traceloom.plans.filters import Filter, bounded_predicate
from traceloom.plans.views import View

BYTE_ORDER_MARK = "﻿"
_FORMULA = re.compile(r"[=+@]|-\D")
_FLAT = str.maketrans("\t\r\n", "   ")


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    rows: int


def cell(value: object) -> str:
    """A value as text: floats in their shortest form, times as in RFC 3339."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%SZ")
    return value.isoformat() if isinstance(value, date) else str(value)


def csv_cell(value: object) -> str:
    text = cell(value)
    text = f"'{text}" if _FORMULA.match(text) else text
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\r\n') else text


KINDS = {"tsv": ("\t", "\n", lambda value: cell(value).translate(_FLAT)), "csv": (",", "\r\n", csv_cell)}


def export_view(rows: DataFrame, view: View, wanted: Filter, columns: list[str], path: str, kind: str = "tsv", limit: int | None = None) -> None:
    """Write what a view's filter finds, newest first: all of it, or nothing if the view needs a filter and has none, or if there are more rows than ``limit``, where one is given."""
    found = rows.where(bounded_predicate(view, wanted)).orderBy(*newest_first(view)).select(*columns)
    rows.sparkSession.dataSource.register(Export)
    found.write.format("export").options(path=path, kind=kind, limit="" if limit is None else str(limit)).mode("append").save()


class Export(DataSource):
    @classmethod
    def name(cls) -> str:
        return "export"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("an export is never overwritten")
        return ExportWriter(schema.names, dict(self.options))


class ExportWriter(DataSourceArrowWriter):
    def __init__(self, names: list[str], options: dict[str, str]):
        self.kind = options.get("kind", "tsv")
        self.between, self.end, _ = KINDS[self.kind]
        self.labels = options["labels"].split(",") if options.get("labels") else names
        if len(self.labels) != len(names):
            raise ValueError("as many labels as columns are needed")
        self.header = options.get("header", "true") == "true"
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.path = options["path"].rstrip("/")
        self.staging = f"{self.path}-{uuid.uuid4().hex}"
        store, root = self._store(self.path)
        if store.get_file_info(root).type.name != "NotFound":
            raise ValueError(f"{self.path} is there already")
        store.create_dir(self._store(self.staging)[1])

    @staticmethod
    def _store(url: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(url)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        to_text = KINDS[self.kind][2]
        store, root = self._store(self.staging)
        file = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.{self.kind}"
        rows = 0
        with store.open_output_stream(f"{root}/{file}") as out:
            if self.header:
                out.write((BYTE_ORDER_MARK + self.between.join(map(to_text, self.labels)) + self.end).encode())
            for batch in iterator:
                columns = [list(map(to_text, column.to_pylist())) for column in batch.columns]
                lines = [self.between.join(values) + self.end for values in zip(*columns, strict=True)]
                out.write("".join(lines).encode())
                rows += len(lines)
        return Written(context.partitionId(), file, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """The files of the attempts that count are named; those of other attempts go with the folder."""
        written = [m for m in messages if m is not None]
        total = sum(m.rows for m in written)
        if self.limit is not None and total > self.limit:
            raise ValueError(f"{total} rows are more than {self.limit}")
        store, root = self._store(self.staging)
        known = {m.file for m in written if m.rows} or {m.file for m in written[:1]}
        from pyarrow import fs

        for info in store.get_file_info(fs.FileSelector(root)):
            if info.base_name not in known:
                store.delete_file(info.path)
        store.move(root, self._store(self.path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store(self.staging)
        store.delete_dir(root)
