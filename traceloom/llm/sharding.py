"""Sharding by Karmarkar-Karp differencing: shards of near equal bytes, equal texts together.

All rows with one text are a group that is never split; a group weighs the UTF-8 bytes of its texts plus
``OVERHEAD`` a row. Differencing keeps partial partitions, each ``shards`` parts with sums: first
one a group, with one part filled. The two of largest spread (greatest sum less least) are combined time
and again, the greatest part of one with the least of the other, until one is left; its parts are the shards.

Differencing takes items one after the other, so it needs a bounded number of them. A group heavier than the
``HEAVY``-th part of a mean shard is an item of its own: there are fewer than ``shards * HEAVY`` of those, whatever the
corpus. All lighter groups are dealt by hash into ``BUNDLES`` bundles, each an item. So one task gets at most
``shards * HEAVY + BUNDLES`` sums, and rows find their shard by two joins with tables of that size.

Slots number the rows of a shard from 0 without a gap: rows are dealt by a hash of id and group into ``CELLS`` cells a shard,
cells start where the counts of those before end, and rows are numbered within their cell.

Cases: null and empty texts are one group of rows that weigh ``OVERHEAD`` each; repeated rows stay together and take slots of
their own; ties of weight go to the smaller key, ties of slot are between rows equal in id and text; a group heavier than
a mean shard fills one alone, and the others share the rest evenly; shards can be empty in a small table; an empty table gives
an empty result; columns of the input are kept as they are, whatever their names, in the struct ``row``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceloom.llm.common import stored

SHARDS = 40
OVERHEAD = 16
HEAVY = 64
BUNDLES = 8192
CELLS = 1024

Part = tuple[int, int]


def weight(text: Column) -> Column:
    """Bytes that a row takes."""
    return (F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) + OVERHEAD).cast("long")


def differenced(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item; shards are numbered from the heaviest."""
    joined: list[tuple[int, int]] = []
    n = len(sizes)

    def put(parts: list[Part]) -> None:
        parts.sort(key=lambda p: -p[0])
        least = parts[-1][0]
        heapq.heappush(heap, (least - parts[0][0], len(joined), [(s - least, node) for s, node in parts]))

    # a node below n is an item, one from n on joins two nodes, -1 is an empty part
    heap: list[tuple[int, int, list[Part]]] = []
    for i, size in enumerate(sizes):
        heap.append((-size if shards > 1 else 0, i - n, [(size, i)] + [(0, -1)] * (shards - 1)))
    heapq.heapify(heap)
    while len(heap) > 1:
        one, other = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = []
        for (a, left), (b, right) in zip(one, reversed(other), strict=True):
            if left >= 0 and right >= 0:
                joined.append((left, right))
                left = n + len(joined) - 1
            parts.append((a + b, max(left, right)))
        put(parts)
    found = [0] * n
    for shard, (_, node) in enumerate(heap[0][2] if heap else []):
        todo = [node] if node >= 0 else []
        while todo:
            at = todo.pop()
            if at < n:
                found[at] = shard
            else:
                todo.extend(joined[at - n])
    return found


def _deal(shards: int):
    """A task's function: the shard of every item; the items come as one bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sorted((-row["bytes"], not row["heavy"], row["item"]) for batch in batches for row in batch.to_pylist())
        found = differenced([-size for size, _, _ in items], shards)
        yield pa.RecordBatch.from_arrays([pa.array([not light for _, light, _ in items], pa.bool_()), pa.array([item for _, _, item in items], pa.int64()), pa.array(found, pa.int32())], ["heavy", "item", "shard"])

    return run


def _items(groups: DataFrame, shards: int, heavy: int, bundles: int) -> DataFrame:
    """(heavy, item, bytes): heavy groups by their key, and bundles of the others by their number."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    own = F.col("bytes") * heavy * shards > F.lit(total)
    item = F.when(own, F.col("group")).otherwise(F.pmod("group", F.lit(bundles)))
    return groups.groupBy(own.alias("heavy"), item.alias("item")).agg(F.sum("bytes").alias("bytes"))


def place(docs: DataFrame, shards: int = SHARDS, heavy: int = HEAVY, bundles: int = BUNDLES, cells: int = CELLS, keep: list[str] | None = None) -> DataFrame:
    """(row, size, shard, slot) of each row of ``docs``, with the columns ``keep`` (all, if none are named) in ``row``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col("doc_id").alias("id"), weight(F.col("text")).alias("size"), F.xxhash64(text).alias("group"))
    groups = stored(sized.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    places = stored(_items(groups, shards, heavy, bundles).repartition(1).mapInArrow(_deal(shards), "heavy boolean, item long, shard int"), "shard-places")
    # at most shards * heavy rows, and at most ``bundles`` rows
    own = F.broadcast(places.where("heavy").select(F.col("item").alias("group"), F.col("shard").alias("own_shard")))
    shared = F.broadcast(places.where("NOT heavy").select(F.col("item").alias("bundle"), F.col("shard").alias("bundle_shard")))
    dealt = stored(
        sized.join(own, "group", "left").withColumn("bundle", F.pmod("group", F.lit(bundles))).join(shared, "bundle", "left")
        .select("row", "id", "size", "group", F.coalesce("own_shard", "bundle_shard").alias("shard"), F.pmod(F.xxhash64("id", "group"), F.lit(cells)).alias("cell")),
        "shard-rows",
    )
    counts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards * cells rows
    starts = F.broadcast(counts.select("shard", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")))
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "group"))
    return dealt.withColumn("nth", nth).join(starts, ["shard", "cell"]).select("row", "size", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """Write placed rows as one folder a shard, in files ordered by slot."""
    rows = placed.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
