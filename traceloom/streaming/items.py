"""What is known of each item across runs: when it was first seen and last changed, and whether its details must be fetched again.

Each input row is one attempt at an item: its key, when, whether it went well, and then the digest of what was read. A failed attempt keeps the
last good digest and leaves the item pending; a timer then asks for it again once the stream's time has passed the attempt by ``delay``, until an attempt goes well.

State is kept by Spark (``transformWithState``, in RocksDB), by key, so it grows with the items and not with the attempts. A trigger's rows of one key are put
in order in the task, so triggers must be bounded (``maxFilesPerTrigger``); ties of time go by digest. Rows older than the watermark are dropped by Spark
before they get here, so ``late`` must cover what a source can be late by.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATE = StructType([
    StructField("digest", StringType()), StructField("first_seen", TimestampType()), StructField("last_change", TimestampType()), StructField("pending", BooleanType()),
    StructField("attempts", IntegerType()), StructField("attempted", TimestampType()), StructField("seen", LongType()),
])
OUTPUT = StructType([StructField("key", StringType()), StructField("kind", StringType()), *STATE])


def named(key: str, kind: str, state: tuple) -> Row:
    return Row(**dict(zip(OUTPUT.names, (key, kind, *state), strict=True)))


class Items(StatefulProcessor):
    def __init__(self, delay: timedelta):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.item.get() if self.item.exists() else None
        digest, first, change, pending, attempts, attempted, seen = found or (None, None, None, False, 0, None, 0)
        kinds = set()
        for row in sorted(rows, key=lambda r: (r.at, r.digest or "")):
            seen += 1
            attempted = row.at
            if not row.ok:
                pending, attempts = True, attempts + 1
                kinds.add("failed")
                continue
            pending, attempts = False, 0
            if first is None:
                first = change = row.at
                kinds.add("new")
            elif row.digest != digest:
                change = row.at
                kinds.add("changed")
            digest = row.digest
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if pending:
            self.handle.registerTimer(int((attempted + self.delay).timestamp() * 1000))
        state = (digest, first, change, pending, attempts, attempted, seen)
        self.item.update(state)
        kind = next((k for k in ("new", "changed") if k in kinds), "failed" if pending else "unchanged")
        yield named(key[0], kind, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Ask for the item again, and again after the same time."""
        state = self.item.get()
        if state and state[3]:
            due = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000) + self.delay
            if due.timestamp() * 1000 > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(int(due.timestamp() * 1000))
            yield named(key[0], "retry", state)

    def close(self) -> None:
        pass


def item_states(attempts: DataFrame, late: str = "0 seconds", delay: timedelta = timedelta(hours=6)) -> DataFrame:
    """(key, kind, and the state) for each key of a trigger's rows: new, changed, unchanged or failed; and a row of kind retry for each item that is due.

    ``attempts`` is a stream of (key, at, ok, digest).
    """
    rows = attempts.withWatermark("at", late).groupBy("key")
    return rows.transformWithState(Items(delay), OUTPUT, "Append", "EventTime")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep their state in RocksDB."""
    session = spark.newSession()
    session.conf.set(PROVIDER, ROCKSDB)
    return session


def latest(states: DataFrame) -> DataFrame:
    """The newest state of each key, out of all that a stream has written; equal states repeat in retries."""
    newest = F.max_by(F.struct(*STATE.names), "seen")
    return states.groupBy("key").agg(newest.alias("s")).select("key", "s.*")


def retries(states: DataFrame, limit: int | None = None) -> DataFrame:
    """The pending items, those attempted longest ago first."""
    due = latest(states).where("pending").orderBy("attempted", "key")
    return due if limit is None else due.limit(limit)
