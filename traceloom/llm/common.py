"""Shared storage and row helpers for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a pre-aggregated table may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Removes the shuffle files of a plan when its execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a task hands to Python at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the session's checkpoint folder.

    A local master (a test, a bench) that has none gets a temporary one; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="traceloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, put back at the end."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder and read it back: cuts the lineage durably. The shuffle files that this took go at once."""
    path = new_path(df.sparkSession, name)
    with setting(df.sparkSession, CLEANUP, "true"):
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(result: DataFrame, *tables: DataFrame) -> DataFrame:
    """``result``, which reads none of the stored ``tables``; their files are deleted."""
    spark = result.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
    for folder in {name.rsplit("/", 1)[0] for t in tables for name in t.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if not path.toUri().getPath().startswith(root + "/"):
            raise ValueError(f"{folder} is not in the shared folder")
        path.getFileSystem(conf).delete(path, True)
    return result


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark deletes the shuffle files of plans that are done only then, which on an idle driver can be half an hour later."""
    spark.sparkContext._jvm.System.gc()


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by ``|``."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
