"""Rows after a cursor as a stream: the offset is the place, a tuple of the sort columns, of the last matched row.

``store`` writes rows with the matched ones apart, each file sorted by the columns of the cursor. The stream reads matched rows only, from after the
start place up to the greatest place that is there, one task a file; files whose places are all before or behind are left out. Rows that don't
match never move the offset, so they are met again once they do. Rows that come late, below the cursor, are lost by design.

    spark.dataSource.register(CursorRows)
    spark.readStream.format("cursor_rows").schema(schema).option("path", url).option("columns", "GSTRS,SPEC,HISTROYID").load()

The greatest place is found from each new file's last row, so the driver reads a footer and a row group's end of a file once. The columns of the cursor must be texts and not null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

MATCHED = "matched"


def store(rows: DataFrame, matched: Column, columns: list[str], url: str, mode: str = "append") -> None:
    """Add rows; ``matched`` tells those that the cursor moves over."""
    flagged = rows.withColumn(MATCHED, matched)
    flagged.sortWithinPartitions(MATCHED, *columns).write.mode(mode).partitionBy(MATCHED).parquet(url)


@dataclass
class Piece(InputPartition):
    file: str
    start: list[str] | None
    end: list[str]

    def __init__(self, file: str, start: list[str] | None, end: list[str]):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


def beyond(columns: list[str], place: list[str], strictly: bool = True):
    """Rows whose tuple is greater than ``place`` (or equal, if not strictly), as a scan's filter."""
    import pyarrow.compute as pc

    found = pc.scalar(not strictly)
    for c, value in reversed(list(zip(columns, place, strict=True))):
        found = (pc.field(c) > pc.scalar(value)) | ((pc.field(c) == pc.scalar(value)) & found)
    return found


class CursorRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor_rows"

    def schema(self) -> str:
        raise ValueError("name the columns by schema()")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return CursorReader(schema, dict(self.options))


class CursorReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.names
        self.url, self.columns = options["path"].rstrip("/"), options["columns"].split(",")
        self.start = json.loads(options["start"]) if options.get("start") else None
        self.ends: dict[str, tuple[list[str], list[str]] | None] = {}

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.url)

    def _files(self) -> dict[str, tuple[list[str], list[str]]]:
        """First and last place of each file; files never change, so each is looked at once."""
        from pyarrow import fs, parquet

        files, root = self._store()
        there = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/{MATCHED}=true", allow_not_found=True)) if f.is_file and f.base_name.endswith(".parquet")]
        for path in there:
            if path not in self.ends:
                with files.open_input_file(path) as source:
                    file = parquet.ParquetFile(source)
                    groups = [g for g in range(file.num_row_groups) if file.metadata.row_group(g).num_rows]
                    read = lambda g, n, file=file: [str(file.read_row_group(g, columns=[c]).column(0)[n].as_py()) for c in self.columns]
                    self.ends[path] = (read(groups[0], 0), read(groups[-1], -1)) if groups else None
        return {p: self.ends[p] for p in there if self.ends[p]}

    def initialOffset(self) -> dict:
        return {"place": self.start}

    def latestOffset(self) -> dict:
        places = [last for _, last in self._files().values()] + ([self.start] if self.start else [])
        return {"place": max(places) if places else None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["place"], end["place"]
        if high is None or (low is not None and high <= low):
            return []
        return [Piece(file, low, high) for file, (first, last) in sorted(self._files().items()) if first <= high and (low is None or last > low)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset

        files, _ = self._store()
        wanted = [~beyond(self.columns, piece.end)] + ([beyond(self.columns, piece.start)] if piece.start is not None else [])
        yield from dataset.dataset(piece.file, filesystem=files, format="parquet").to_batches(columns=self.names, filter=reduce(lambda a, b: a & b, wanted))

    def commit(self, end: dict) -> None:
        """The checkpoint has the place; nothing is kept here."""
