"""Incremental reads: marks with look-back, tuple cursors, and windows of days."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.scalars import after, in_days, up_to
from traceloom.operators.reconcile import classify


def since_mark(rows: DataFrame, time: str, mark: str, days: int, orders: list[str] | None = None) -> DataFrame:
    """Rows from ``days`` before the mark on; late rows come again, and the upsert absorbs them. An empty list of orders reads nothing."""
    found = rows.where(F.col(time) >= F.lit(mark).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return found if orders is None else found.where(F.col("AUFNR").isin(*orders) if orders else F.lit(False))


@dataclass(frozen=True)
class SourceSpec:
    """What a source's rows are read by: its columns, the time of its mark, the column of days that scopes it, its planned start, and its order."""

    columns: tuple[str, ...]
    mark: str | None
    scope: str | None
    planned: str | None
    order: tuple[str, ...]


def source_scan(rows: DataFrame, spec: SourceSpec, mode: str = "full", mark: str | None = None, look_back: int = 0, scope: tuple[str | None, str | None] = (None, None), orders: list[str] | None = None, planned: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """The columns of a source in its order: since the mark less ``look_back`` days in incremental mode, within the scope's days and those of the planned start, of the given orders.

    An empty list of orders reads nothing; none at all reads all. Every condition is a comparison with a literal, so it reaches the scan.
    """
    if mode not in ("full", "incremental"):
        raise ValueError(f"no mode {mode!r}")
    found = rows
    if mode == "incremental" and mark is not None and spec.mark:
        found = found.where(F.col(spec.mark) >= F.lit(mark).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(look_back)} DAYS"))
    for column, (first, last) in ((spec.scope, scope), (spec.planned, planned)):
        if column and (first or last):
            found = found.where(in_days(F.col(column), first, last))
    if orders is not None:
        found = found.where(F.col("AUFNR").isin(*orders) if orders else F.lit(False))
    return found.select(*spec.columns).orderBy(*spec.order)


def next_mark(rows: DataFrame, time: str, mark: str) -> DataFrame:
    """The greater of the mark and the newest row; it never goes back."""
    newest = F.date_format(F.max(time), "yyyy-MM-dd HH:mm:ss")
    return rows.agg(F.greatest(F.lit(mark), F.coalesce(newest, F.lit(mark))).alias("mark"))


def between_places(rows: DataFrame, columns: list[str], start: list, end: list) -> DataFrame:
    """Rows after the start tuple, up to and with the end tuple. Rows that come late below the cursor are lost by design."""
    return rows.where(after(columns, start) & up_to(columns, end))


def next_place(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The greatest tuple of the rows."""
    place = F.max(F.struct(*columns))
    return rows.agg(*[place[c].alias(c) for c in columns])


def day_windows(spark: SparkSession, first: str, last: str, days: int) -> DataFrame:
    """(first_day, last_day) of windows of ``days`` days; the last one ends with ``last``."""
    starts = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"INTERVAL {int(days)} DAYS"))).alias("first_day")
    return spark.range(1).select(starts).withColumn("last_day", F.least(F.date_add("first_day", days - 1), F.lit(last).cast("date")))


def windows_of(rows: DataFrame, day: str, days: int) -> DataFrame:
    """(first_day, last_day) of windows over the days that the rows have; none without rows."""
    ends = rows.agg(F.min(day).alias("first"), F.max(day).alias("last")).where("first IS NOT NULL")
    starts = F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {int(days)} DAYS"))).alias("first_day")
    return ends.select("last", starts).select("first_day", F.least(F.date_add("first_day", days - 1), "last").alias("last_day"))


def retry_queue(rows: DataFrame, pending: str, attempted: str, key: str, limit: int) -> DataFrame:
    """The rows to try again, longest waiting first; those never tried come before."""
    return rows.where(pending).orderBy(F.col(attempted).asc_nulls_first(), key).limit(limit)


def after_anchor(rows: DataFrame, columns: list[str], start: list, end: list) -> DataFrame:
    """As ``between_places``, if the row of the start tuple is there exactly once; else it's an error, as the source isn't the one that the cursor was taken from."""
    same = F.struct(*[F.col(c) for c in columns]) == F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, start, strict=True)])
    if (seen := rows.where(same).limit(2).count()) != 1:
        raise ValueError(f"the row of the cursor is there {'more than once' if seen else 'no more'}")
    return between_places(rows, columns, start, end)


def committed_marks(marks: DataFrame, outcomes: DataFrame, mark: str) -> DataFrame:
    """(source, mark): every source's mark moves to ``mark`` if all outcomes (source, success) are good and none is absent, else none moves; no mark goes back."""
    bad = marks.join(outcomes, "source", "left").agg(F.count_if(~F.coalesce("success", F.lit(False))).alias("bad"))
    moved = F.when(F.col("bad") == 0, F.greatest("mark", F.lit(mark))).otherwise(F.col("mark"))
    return marks.join(F.broadcast(bad)).select("source", moved.alias("mark"))


def rolling_changes(snapshot: DataFrame, stored: DataFrame, keys: list[str], values: list[str], day: str, first: str, last: str) -> DataFrame:
    """Every key with ``action``, as ``classify``; a stored row is stale only if its day is in the window that the snapshot covers, and stays (``outside``) else."""
    actions = classify(snapshot, stored, keys, values)
    days = stored.select(*keys, F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")).alias("inside"))
    joined = actions.join(days, keys, "left")
    return joined.select(*keys, F.when((F.col("action") == "stale") & ~F.coalesce("inside", F.lit(False)), "outside").otherwise(F.col("action")).alias("action"))


def planned(actions: DataFrame) -> DataFrame:
    """What a run would do, without doing it: the number of keys by action."""
    return actions.groupBy("action").agg(F.count("*").alias("n"))
