"""Sinks: tab- and comma-separated text, and versioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.scalars import flat_cell, safe_cell


def tsv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One ``line`` a row; tabs and line ends in values become blanks."""
    return rows.select(F.concat_ws("\t", *[flat_cell(c) for c in columns]).alias("line"))


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One ``line`` a row, quoted where needed, and safe for spreadsheets."""
    def cell(c: str):
        value = safe_cell(c)
        return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)

    return rows.select(F.concat_ws(",", *[cell(c) for c in columns]).alias("line"))


def write_tsv(rows: DataFrame, columns: list[str], path: str) -> None:
    """Part files of lines, each partition written where it is."""
    tsv_lines(rows, columns).write.text(path)


def open_columns(rows: DataFrame, fixed: list[str], rest: str) -> DataFrame:
    """The fixed columns, then those keys of the map column ``rest`` that occur, in order; the keys are few, as they become columns."""
    keys = [r["key"] for r in rows.select(F.explode(F.map_keys(rest)).alias("key")).distinct().orderBy("key").limit(1001).collect()]
    if len(keys) > 1000:
        raise ValueError("more than 1000 different keys")
    return rows.select(*fixed, *[F.col(rest)[k].alias(k) for k in keys if k not in fixed])


def write_version(rows: DataFrame, root: str, version: int) -> str:
    """Write a new version beside the ones before; a version that is being read is never overwritten."""
    path = f"{root.rstrip('/')}/version={version}"
    rows.write.mode("error").parquet(path)
    return path


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of a dataset that ``write_version`` wrote."""
    return spark.read.parquet(f"{root.rstrip('/')}/version={max(versions(spark, root))}")


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions of a dataset, by the names of their folders."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(int(name.partition("=")[2]) for x in listed if (name := x.getPath().getName()).startswith("version="))


def retired(spark: SparkSession, root: str, apply: bool = False) -> DataFrame:
    """(version, rows) of a dataset that is given up; its files are deleted only with ``apply``."""
    found = [(n, spark.read.parquet(f"{root.rstrip('/')}/version={n}").count()) for n in versions(spark, root)]
    if apply:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return spark.createDataFrame(found, "version int, rows long")
