"""Sharding against plain differencing, and what must hold of any result."""

import heapq
import random
from collections import defaultdict

import pytest

from traceloom.llm import sharding as h


def plain_differencing(sizes, shards):
    """Sums of the shards, by sets of items and full vectors."""
    heap = [(-size if shards > 1 else 0, i - len(sizes), [(size, [i])] + [(0, [])] * (shards - 1)) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    n = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, b[::-1])), key=lambda t: -t[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, parts))
        n += 1
    return [sorted(p) for _, p in heap[0][2]]


@pytest.mark.parametrize("shards", [1, 2, 5, 40])
def test_as_plain_differencing(shards):
    rng = random.Random(shards)
    for n in (1, 2, 7, 60, 300):
        sizes = sorted((int(rng.paretovariate(1.1) * 100) for _ in range(n)), reverse=True)
        found = h.differenced(sizes, shards)
        parts = defaultdict(list)
        for i, s in enumerate(found):
            parts[s].append(i)
        sums = lambda ps: sorted(sum(sizes[i] for i in p) for p in ps)
        wanted = plain_differencing(sizes, shards)
        assert sums(wanted) == sorted([0] * (shards - len(parts)) + sums(parts.values()))


def test_known_case_and_empty():
    # two-way differencing of 8 7 6 5 4 ends at a difference of 2
    parts = h.differenced([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, p in zip([8, 7, 6, 5, 4], parts) if p == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16]
    assert h.differenced([], 3) == []


def test_even_items_end_close():
    rng = random.Random(9)
    sizes = sorted((rng.randint(10_000, 90_000) for _ in range(8000)), reverse=True)
    sums = [0] * 40
    for size, shard in zip(sizes, h.differenced(sizes, 40)):
        sums[shard] += size
    assert max(sums) - min(sums) < 100


def placed(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int, size double").repartition(5)
    return h.place(docs, **options).collect()


def check(found, rows, shards):
    assert len(found) == len(rows)
    groups, slots, sums = defaultdict(set), defaultdict(list), [0] * shards
    for r in found:
        text = r.row.text or ""
        assert r.size == len(text.encode()) + 16
        groups[text].add(r.shard)
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sums


def test_rows_hot_group_null_repeated_and_clashing(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 900) + str(i), "s", 1, 2.0) for i in range(1500)] + [(i, "hot é" * 40, "s", 1, 2.0) for i in range(900)]
    rows += [(None, None, "s", 1, 2.0), (7, "", None, None, None), (7, "same", "s", 1, 2.0), (7, "same", "s", 1, 2.0), (8, "long " * 40_000, "s", 1, 2.0)]
    for heavy, bundles, near in ((64, 8192, 200), (2, 64, 11_000)):
        sums = sorted(check(placed(spark, rows, shards=8, heavy=heavy, bundles=bundles, cells=4), rows, 8))
        light = sums[:6]
        # the long text and the hot group fill a shard each, the others share the rest
        assert sums[6:] == [200_016, 230_400] and max(light) - min(light) < near


def test_reruns_agree_and_empty_table(spark):
    rows = [(i, f"text {i % 50} " * (i % 9), "s", 1, 2.0) for i in range(300)]
    one, two = (sorted((r.row.doc_id, r.shard, r.slot) for r in placed(spark, rows, shards=4)) for _ in range(2))
    assert one == two
    assert placed(spark, []) == []
    assert {r.shard for r in placed(spark, [(1, "a", "s", 1, 2.0), (2, None, "s", 1, 2.0)])} == {0, 1}


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}" * (i % 20)) for i in range(400)], "doc_id long, text string")
    h.write_shards(h.place(docs, shards=4), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 400 and sorted(p.name for p in (tmp_path / "out").glob("_shard=*")) == [f"_shard={i}" for i in range(4)]
