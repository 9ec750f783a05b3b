"""The keyed store: buckets, versions, writers, streams."""

import json
import re

import pytest

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from traceloom.operators import reconcile
from traceloom.sources.keyed import Conflict, KeyedStore
from traceloom.streaming import passes

SCHEMA = StructType([StructField("k", StringType()), StructField("x", StringType()), StructField("at", IntegerType())])


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def content(df):
    return sorted(tuple(r) for r in df.collect())


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}", SCHEMA, ["k"], buckets=8)


def test_as_the_batch_upsert(spark, store):
    old = [(f"k{i}", f"x{i}", 1) for i in range(40)]
    new = [(f"k{i}", f"x{i}" if i % 2 else f"y{i}", 1) for i in range(20, 60)]
    store.upsert(rows(spark, old), "t1")
    assert content(store.read()) == sorted((*r, "t1", "t1", 1) for r in old)
    stored = store.read()
    wanted = reconcile.upserted(stored, rows(spark, new), ["k"], ["x", "at"], "t2")
    store.upsert(rows(spark, new), "t2")
    assert content(store.read()) == content(wanted.select(store.read().columns))
    assert store.versions() == [1, 2] and store.manifest().version == 2


def test_only_touched_buckets_are_written(spark, store, tmp_path):
    store.upsert(rows(spark, [(f"k{i}", "x", 1) for i in range(100)]), "t1")
    before, first = files(tmp_path), store.manifest()
    some = rows(spark, [("k3", "new", 1)])
    store.upsert(some, "t2")
    bucket = some.select(store._bucket(8)).first()[0]
    after, second = files(tmp_path), store.manifest()
    assert {f: t for f, t in after.items() if f in before} == before
    new = set(after) - set(before)
    assert new and all(re.search(rf"_bucket={bucket}/", f) for f in new)
    assert {b for b in first.folders if first.folders[b] != second.folders[b]} == {str(bucket)}
    assert {r.x for r in store.read().where("k = 'k3'").collect()} == {"new"} and store.read().count() == 100


def test_readers_keep_their_version(spark, store):
    store.upsert(rows(spark, [("a", "1", 1), ("b", "1", 1)]), "t1")
    reader = store.read()
    store.upsert(rows(spark, [("a", "2", 1)]), "t2")
    store.delete(rows(spark, [("b", None, None), ("z", None, None)]))
    assert {(r.k, r.x) for r in reader.collect()} == {("a", "1"), ("b", "1")}
    assert {(r.k, r.x) for r in store.read(2).collect()} == {("a", "2"), ("b", "1")}
    assert {(r.k, r.x) for r in store.read().collect()} == {("a", "2")}


def test_lookup_reads_only_buckets_of_its_keys(spark, store):
    store.upsert(rows(spark, [(f"k{i}", "x", 1) for i in range(100)]), "t1")
    found = store.lookup(rows(spark, [("k7", None, None), ("no", None, None)]))
    assert [r.k for r in found.collect()] == ["k7"]
    assert len({f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles()}) <= 2


def test_two_writers(spark, store, monkeypatch):
    store.upsert(rows(spark, [("a", "1", 1)]), "t1")
    other = KeyedStore(spark, store.root, SCHEMA, ["k"], buckets=8)
    begun = other.manifest()
    store.upsert(rows(spark, [("a", "2", 1)]), "t2")
    monkeypatch.setattr(other, "manifest", lambda version=None: begun)
    with pytest.raises(Conflict):
        other.upsert(rows(spark, [("a", "3", 1)]), "t3")
    assert {r.x for r in store.read().collect()} == {"2"} and store.versions() == [1, 2]


def test_rivals_null_keys_and_empty(spark, store):
    assert store.read().count() == 0
    store.upsert(rows(spark, [("a", "1", 1), ("a", "1", 1), (None, "n", 1)]), "t1")
    assert content(store.read().where("k IS NOT NULL")) == [("a", "1", 1, "t1", "t1", 1)]
    for rivals in ([("a", "1", 1), ("a", "2", 1)], [("a", "2", 1), ("a", "1", 1)], [("z", "2", 1), ("z", None, 1)]):
        with pytest.raises(Exception, match="different rows of one key"):
            store.upsert(rows(spark, rivals), "t2")
    assert store.versions() == [1]
    store.upsert(rows(spark, []), "t3")
    store.delete(rows(spark, [(None, None, None)]))
    assert [r.k for r in store.read().collect()] == ["a"] and store.versions() == [1, 2, 3]


def test_late_rows_lose(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}", SCHEMA, ["k"], order="at", buckets=4)
    store.upsert(rows(spark, [("a", "5", 5), ("a", "3", 3), ("b", "1", 1)]), "t1")
    store.upsert(rows(spark, [("a", "4", 4), ("b", "2", 2)]), "t2")
    assert content(store.read()) == [("a", "5", 5, "t1", "t1", 1), ("b", "2", 2, "t1", "t2", 2)]


def test_vacuum(spark, store, tmp_path):
    for i in range(4):
        store.upsert(rows(spark, [("a", str(i), 1), (f"b{i}", "x", 1)]), f"t{i}")
    kept = content(store.read())
    gone = store.vacuum(keep=1)
    assert gone and store.versions() == [4] and content(store.read()) == kept
    named = set(store.manifest().folders.values())
    assert {f.rsplit("/", 1)[0] for f in files(tmp_path)} == named


def test_stream_batches_replays_and_late_rows(spark, tmp_path):
    source = tmp_path / "in"
    for n, data in enumerate([[("a", "1", 1), ("b", "9", 9)], [("a", "3", 3), ("b", "2", 2)], [("a", "2", 2), ("c", "1", 1)]]):
        rows(spark, data).coalesce(1).write.parquet(f"file://{source}/f{n}")
    store = KeyedStore(spark, f"file://{tmp_path}/store", SCHEMA, ["k"], order="at", buckets=4)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{source}/*")
    passes.upsert_available(stream(), store, f"file://{tmp_path}/marks", "passes", "t1")
    wanted = [("a", "3", 3), ("b", "9", 9), ("c", "1", 1)]
    assert [r[:3] for r in content(store.read())] == wanted and store.manifest().streams == {"passes": 2}
    versions = store.versions()
    # the last batch was upserted, but its commit is lost: it runs again
    (tmp_path / "marks" / "commits" / "2").unlink()
    (tmp_path / "marks" / "commits" / ".2.crc").unlink(missing_ok=True)
    passes.upsert_available(stream(), store, f"file://{tmp_path}/marks", "passes", "t2")
    assert store.versions() == versions and [r[:3] for r in content(store.read())] == wanted
    rows(spark, [("d", "1", 1)]).coalesce(1).write.parquet(f"file://{source}/f9")
    passes.upsert_available(stream(), store, f"file://{tmp_path}/marks", "passes", "t3")
    assert [r.k for r in store.read().orderBy("k").collect()] == ["a", "b", "c", "d"] and len(store.versions()) == len(versions) + 1


def test_manifest_is_plain_json(spark, store, tmp_path):
    store.upsert(rows(spark, [("a", "1", 1)]), "t1", "s", 0)
    found = json.loads((tmp_path / "manifests" / "0000000001.json").read_text())
    assert found["streams"] == {"s": 0} and list(found["folders"]) == [str(rows(spark, [("a", None, None)]).select(store._bucket(8)).first()[0])]


def test_backfill_by_pages_goes_on_where_it_stopped(spark, store, tmp_path):
    store.upsert(rows(spark, [(f"k{i}", None if i % 3 else "set", i) for i in range(60)]), "t1")
    value, where = F.concat(F.lit("v"), "at"), F.col("x").isNull()
    pages = store.backfill("x", value, where, "t2", page=3)
    (first, n) = next(pages)
    # another writer sets one of the rows that are left
    left = [r.k for r in store.read().where("x IS NULL").collect()]
    store.upsert(rows(spark, [(left[0], "other", 0)]), "t3")
    changed = n + sum(n for _, n in store.backfill("x", value, where, "t2", page=3, first=first))
    found = {r.k: r.x for r in store.read().collect()}
    assert changed == 40 - 1 and found[left[0]] == "other"
    assert all(x == ("set" if int(k[1:]) % 3 == 0 else f"v{k[1:]}") for k, x in found.items() if k != left[0])
    versions = store.versions()
    assert [n for _, n in store.backfill("x", value, where, "t4")] == [0] and store.versions() == versions
