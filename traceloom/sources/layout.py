"""Datasets stored with their normalised columns, so that filters and joins need no text work at read time.

``ingest`` writes a dataset once with the day as a DATE, the zero-stripped order numbers (null for a blank), and the month: partitioned by month, and in each
month dealt into buckets by an order number and sorted by it. A filter on days then skips months and row groups; joins of two datasets that are
bucketed by the same number read bucket by bucket, without an exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.scalars import norm_order, text

BUCKETS = 8


def order_number(c: str) -> Column:
    """The zero-stripped number, null for a blank: rows without one meet nothing and are never dealt to one place by it."""
    return norm_order(text(c))


def ingest(rows: DataFrame, root: str, name: str, day: str, numbers: dict[str, str], by: str, buckets: int = BUCKETS) -> DataFrame:
    """Store ``rows`` as a table; ``numbers``: new column to the column of order numbers it is made of, ``by``: the one to deal and sort by.

    Buckets are made by a shuffle beforehand, so each has one file a month and not one a task. Rows without a number are dealt by a hash of all their values.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    wide = rows.withColumns({n: order_number(c) for n, c in numbers.items()} | {"month": F.date_format(F.trunc(day, "MM"), "yyyy-MM")})
    dealt = wide.repartition(buckets, by) if not rows.isStreaming else wide
    dealt.write.partitionBy("month").bucketBy(buckets, by).sortBy(by).option("path", f"{root.rstrip('/')}/{table}").format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


def stored(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def in_months(day: str, first: str | None, last: str | None) -> Column:
    """Days from ``first`` to ``last``, both included and either absent, with the months that they fall to."""
    found = F.lit(True)
    if first:
        found = found & (F.col("month") >= F.lit(first[:7])) & (F.col(day) >= F.lit(first).cast("date"))
    if last:
        found = found & (F.col("month") <= F.lit(last[:7])) & (F.col(day) <= F.lit(last).cast("date"))
    return found


def on_board(rows: DataFrame, board: DataFrame, key: str, yes: bool) -> DataFrame:
    """Rows whose order is (or isn't) on the board, by stored numbers; rows without one are never on it."""
    known = board.select(F.col(key)).where(F.col(key).isNotNull())
    if yes:
        return rows.join(known, key, "left_semi")
    return rows.where(F.col(key).isNotNull()).join(known, key, "left_anti").unionByName(rows.where(F.col(key).isNull()))


def only_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys that have one value; buckets by the key are grouped where they are."""
    ends = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    return ends.where("least = most").select(key, F.col("least").alias(value))


def with_load_time(rows: DataFrame, synced: str) -> DataFrame:
    """The rows with ``synced_us``, the load time in microseconds: a number, so that files know its range."""
    return rows.withColumn("synced_us", F.unix_micros(F.col(synced).cast("timestamp")))


def from_footers(spark: SparkSession, path: str) -> DataFrame:
    """A dataset for counts and ranges: read in a session of its own, whose plans take counts, least and greatest numbers from the files' footers."""
    session = spark.newSession()
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    session.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    return session.read.parquet(path)


def version(stored_rows: DataFrame, name: str) -> DataFrame:
    """``count:latest`` of a dataset stored with its load time; no row group is read if it is opened by ``from_footers``."""
    found = stored_rows.agg(F.count("*").alias("n"), F.max("synced_us").alias("latest"))
    latest = F.coalesce(F.date_format(F.timestamp_micros("latest"), "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return found.select(F.lit(name).alias("dataset"), F.concat_ws(":", F.col("n").cast("string"), latest).alias("version"))


def status(stored_rows: DataFrame, name: str) -> DataFrame:
    found = stored_rows.agg(F.count("*").alias("rows"), F.max("synced_us").alias("latest"))
    return found.select(F.lit(name).alias("dataset"), "rows", F.date_format(F.timestamp_micros("latest"), "yyyy-MM-dd HH:mm:ss").alias("latest"))
