"""Station passes as a stream: late-safe counts by hour, and files turned into an upserted dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.sources.keyed import KeyedStore


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event files in a folder (or matched by a pattern), as a stream."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Passes and total value by hour and type; hours older than the watermark are closed."""
    windows = events.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("hour"), "event_type")
    return windows.agg(F.count("*").alias("passes"), F.sum("value").alias("value")).select(F.col("hour.start").alias("hour"), "event_type", "passes", "value")


def first_passes(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, however often its file brings it, within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def run_available(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop: the incremental load of one run. The checkpoint remembers which files are done."""
    writer = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(path)
    else:
        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

        query = writer.outputMode(mode).foreachBatch(put).start()
    query.awaitTermination()


def upsert_available(rows: DataFrame, store: KeyedStore, checkpoint: str, stream: str, now: str) -> None:
    """Upsert what a stream has into a keyed store, batch by batch, and stop.

    The store keeps the number of the stream's last batch: a batch that is run again, because the checkpoint wasn't written
    after it, changes nothing. Late rows lose against stored ones if the store has an order.
    """
    def put(batch: DataFrame, number: int) -> None:
        store.upsert(batch, now, stream, number)

    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start().awaitTermination()
