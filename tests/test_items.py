"""State of items across runs of a stream."""

from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F
from traceloom.streaming import items, passes


@pytest.fixture
def run(spark, tmp_path):
    session = items.with_rocksdb(spark)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    n = 0

    def go(rows):
        nonlocal n
        data = [(k, datetime(2024, 1, 1) + timedelta(hours=h), d is not None, d) for k, h, d in rows]
        spark.createDataFrame(data, "key string, at timestamp, ok boolean, digest string").coalesce(1).write.parquet(f"file://{tmp_path}/in/f{n}")
        n += 1
        stream = session.readStream.schema("key string, at timestamp, ok boolean, digest string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
        passes.run_available(items.item_states(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/marks")
        return session.read.parquet(f"file://{tmp_path}/out")

    return go


def test_state_goes_on_in_the_next_run(run):
    run([("a", 0, "x"), ("b", 1, "y"), ("c", 2, None), ("a", 3, "x")])
    out = run([("a", 20, "z"), ("b", 21, "y"), ("d", 22, "n"), ("b", 23, None)])
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    found = {r.key: (r.digest, r.first_seen, r.last_change, r.pending, r.attempts, r.seen) for r in items.latest(out).collect()}
    assert found == {"a": ("z", at(0), at(20), False, 0, 3), "b": ("y", at(1), at(1), True, 1, 3), "c": (None, None, None, True, 1, 1), "d": ("n", at(22), at(22), False, 0, 1)}
    kinds = {(r.key, r.kind) for r in out.collect()}
    assert {("a", "new"), ("a", "changed"), ("b", "new"), ("b", "failed"), ("c", "failed"), ("c", "retry"), ("d", "new")} <= kinds and ("a", "retry") not in kinds
    assert [r.key for r in items.retries(out).collect()] == ["c", "b"] and [r.key for r in items.retries(out, 1).collect()] == ["c"]


def test_a_good_attempt_ends_the_retries(run):
    run([("a", 0, None), ("z", 1, "q")])
    run([("a", 2, "x"), ("z", 3, "q")])
    out = run([("z", 40, "q")])
    assert not out.where("kind = 'retry'").count() and items.retries(out).count() == 0
    assert out.where("key = 'z' AND kind = 'unchanged'").count() == 2


def test_an_item_is_asked_for_until_it_goes_well(run):
    run([("a", 0, None)])
    for h in (7, 14):
        out = run([("z", h, "q")])
    assert out.where("key = 'a' AND kind = 'retry'").count() == 2
    assert out.where("key = 'a'").select(F.max("attempts")).first()[0] == 1
