"""A source that answers by ranges of days, as a Spark data source: one request and one task a window of days.

    spark.dataSource.register(DatedRows)
    spark.read.format("dated_rows").schema("AUFNR string, ...").option("url", url).option("start", "2024-01-01").option("end", "2024-03-31").load()

A request is answered by envelopes ``{"MSGTY", "MSGTX", "DATA"}``. An envelope of type E, A or X fails the read, unless its text says that there
are no data; then the window is empty. ``DATA`` must be a list of objects, or the read fails: a wrong answer never counts as an empty one.
Fields that the schema doesn't name are left out, absent ones are null, and others become text. A column ``asked_from`` has the first day of the row's window.

Options: ``url``; ``start`` and ``end`` (days, both included); ``days`` a window (7); ``most_days`` (none; 31 for ad-hoc questions); ``source``;
``order`` (keep the rows of one order, zeros in front or not); ``day`` (a DATE column of the schema on which filters narrow the range, which needs ``spark.sql.python.filterPushdown.enabled``;
Spark still checks them). The url of a folder has recorded answers, one envelope a line, in ``source=S/day=D/``; http(s) urls are asked by POST.
"""

from __future__ import annotations

import io
import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DateType, StringType, StructType

#: Types of failed answers, and how an answer says that there's nothing.
FAILED = ("E", "A", "X")
NOTHING = ("no data", "无数据")
WINDOW, MOST_AD_HOC, ORDER_LENGTH = 7, 31, 40
#: Rows that leave a task together, and rows of a recorded answer.
TOGETHER, ANSWER = 10_000, 2_000


class SourceError(RuntimeError):
    """The source failed, or its answer isn't one."""


@dataclass
class Window(InputPartition):
    first: date
    last: date

    def __init__(self, first: date, last: date):
        super().__init__((first, last))
        self.first, self.last = first, last


def windows(start: date, end: date, days: int) -> list[Window]:
    """Windows of ``days`` days; the last one ends with ``end``."""
    starts = range(0, (end - start).days + 1, days)
    return [Window(start + timedelta(n), min(start + timedelta(n + days - 1), end)) for n in starts]


def rows_of(answer: object) -> list[dict]:
    """The rows of an envelope."""
    if not isinstance(answer, dict):
        raise SourceError("the answer is not an object")
    if str(answer.get("MSGTY") or "").upper() in FAILED:
        said = str(answer.get("MSGTX") or "")
        if any(nothing in said.lower() for nothing in NOTHING):
            return []
        raise SourceError(f"the source says: {said}")
    rows = answer.get("DATA")
    if not isinstance(rows, list) or not all(isinstance(row, dict) for row in rows):
        raise SourceError("the answer has no list of rows")
    return rows


def recorded(url: str, source: str, first: date, last: date) -> Iterator[object]:
    """Envelopes recorded in a folder a day."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(url)
    for n in range((last - first).days + 1):
        folder = fs.FileSelector(f"{root}/source={source}/day={first + timedelta(n)}", allow_not_found=True)
        for file in sorted(store.get_file_info(folder), key=lambda f: f.path):
            if file.is_file and not file.base_name.startswith((".", "_")):
                with io.TextIOWrapper(store.open_input_stream(file.path), "utf-8", newline="\n") as lines:
                    yield from (json.loads(line) for line in lines if line.strip())


def asked(url: str, source: str, first: date, last: date, timeout: int) -> Iterator[object]:
    """The answer of a service to one window."""
    body = json.dumps({"SOURCE": source, "CHDAT": str(first), "CHDAT_TO": str(last)}).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        yield json.load(answer)


def bare(order: object) -> str:
    """An order number without zeros in front, number or not."""
    text = "" if order is None else str(order).strip()
    return text.lstrip("0") or text[-1:]


def as_text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class DatedRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dated_rows"

    def schema(self) -> str:
        raise ValueError("name the columns by schema()")

    def reader(self, schema: StructType) -> DataSourceReader:
        return (NarrowedReader if self.options.get("day") else DatedReader)(schema, dict(self.options))


class DatedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        bad = [f.name for f in schema if not isinstance(f.dataType, (StringType, DateType))]
        if bad:
            raise ValueError(f"columns must be texts or days: {bad}")
        self.names = [f.name for f in schema]
        self.types = [pa.date32() if isinstance(f.dataType, DateType) else pa.string() for f in schema]
        self.url, self.source = options["url"], options.get("source", "")
        self.start, self.end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        self.days, self.timeout = int(options.get("days", WINDOW)), int(options.get("timeout", 30))
        self.order, self.day = options.get("order", "").strip(), options.get("day")
        if self.end < self.start or self.days < 1:
            raise ValueError("the range of days is empty")
        if "most_days" in options and (self.end - self.start).days >= int(options["most_days"]):
            raise ValueError(f"more than {options['most_days']} days")
        if len(self.order) > ORDER_LENGTH:
            raise ValueError("the order number is too long")

    def partitions(self) -> list[Window]:
        return windows(self.start, self.end, self.days)

    def read(self, window: Window | None) -> Iterator[pa.RecordBatch]:
        if window is None:  # filters leave no day
            return
        answers = asked(self.url, self.source, window.first, window.last, self.timeout) if self.url.startswith(("http://", "https://")) else recorded(self.url, self.source, window.first, window.last)
        held: list[dict] = []
        for answer in answers:
            held += [row for row in rows_of(answer) if not self.order or bare(row.get("AUFNR")) == bare(self.order)]
            if len(held) >= TOGETHER:
                yield self._batch(held, window)
                held = []
        yield self._batch(held, window)

    def _batch(self, rows: list[dict], window: Window) -> pa.RecordBatch:
        columns = []
        for name, kind in zip(self.names, self.types, strict=True):
            values = [window.first if name == "asked_from" else row.get(name) for row in rows]
            if kind == pa.date32():
                values = [x if x is None or isinstance(x, date) else date.fromisoformat(str(x)[:10]) for x in values]
            else:
                values = [str(x) if isinstance(x, date) else as_text(x) for x in values]
            columns.append(pa.array(values, kind))
        return pa.RecordBatch.from_arrays(columns, self.names)


class NarrowedReader(DatedReader):
    """A reader that filters on the day narrow; Spark asks for the setting above."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the day narrow the windows; all are still checked, as a window may hold more."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.day,) and isinstance(getattr(f, "value", None), date):
                value = f.value.date() if isinstance(f.value, datetime) else f.value
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.end = min(self.end, value)
            yield f


def record(rows: DataFrame, day: Column, source: Column, path: str, most: int = ANSWER) -> None:
    """Write rows as recorded answers: the rows of a source and day are dealt by a hash of their values to so many envelopes that one has about ``most`` rows or fewer."""
    row = F.struct("*")
    envelope = F.concat(F.lit('{"MSGTY": "S", "MSGTX": "", "DATA": '), F.to_json(F.collect_list("row")), F.lit("}"))
    dated = rows.select(row.alias("row"), source.alias("source"), day.alias("day"), F.xxhash64(*rows.columns).alias("hash"))
    largest = dated.groupBy("source", "day").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    chunk = F.pmod("hash", F.lit(max(1, -(-largest // most)))).alias("chunk")
    dated.groupBy("source", "day", chunk).agg(envelope.alias("value")).drop("chunk").write.partitionBy("source", "day").text(path)
