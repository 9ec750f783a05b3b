"""A stream whose offset is the place of the last matched row."""

import json

import pytest

from pyspark.sql import functions as F
from traceloom.sources import cursor

SCHEMA = "day string, id string, n long"


@pytest.fixture
def source(spark, tmp_path):
    spark.dataSource.register(cursor.CursorRows)
    url = f"file://{tmp_path}/rows"

    def put(rows, parts=2):
        df = spark.createDataFrame(rows, "day string, id string, n long, ok boolean").coalesce(parts)
        cursor.store(df, F.col("ok"), ["day", "id"], url)

    def run(mark="marks", **options):
        out = f"file://{tmp_path}/{mark}-out"
        stream = spark.readStream.format("cursor_rows").schema(SCHEMA).options(path=url, columns="day,id", **options).load()
        stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/{mark}").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        return sorted((r.day, r.id) for r in spark.read.schema(SCHEMA).parquet(out).collect())

    return put, run, tmp_path


def offset(tmp_path, mark="marks"):
    last = max((p for p in (tmp_path / mark / "offsets").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    return json.loads(last.read_text().splitlines()[-1])["place"]


def test_a_restart_leaves_no_gap_and_repeats_nothing(source):
    put, run, tmp_path = source
    put([("d1", "b", 1, True), ("d1", "a", 2, True), ("d2", "a", 3, True), ("d3", "z", 4, False)])
    assert run() == [("d1", "a"), ("d1", "b"), ("d2", "a")] and offset(tmp_path) == ["d2", "a"]
    assert run() == [("d1", "a"), ("d1", "b"), ("d2", "a")]
    put([("d2", "b", 5, True), ("d4", "a", 6, True), ("d2", "a", 7, True), ("d1", "c", 8, True)])
    assert run() == [("d1", "a"), ("d1", "b"), ("d2", "a"), ("d2", "b"), ("d4", "a")] and offset(tmp_path) == ["d4", "a"]


def test_rows_that_do_not_match_hold_the_offset(source):
    put, run, tmp_path = source
    put([("d1", "a", 1, True), ("d5", "a", 2, False), ("d6", "a", 3, False)])
    assert run() == [("d1", "a")] and offset(tmp_path) == ["d1", "a"]
    # the order of the row of day 5 is known now
    put([("d5", "a", 2, True)], 1)
    assert run() == [("d1", "a"), ("d5", "a")] and offset(tmp_path) == ["d5", "a"]


def test_a_given_start_is_exclusive(source):
    put, run, _ = source
    put([("d1", "a", 1, True), ("d1", "b", 2, True), ("d2", "a", 3, True)])
    assert run("other", start='["d1", "a"]') == [("d1", "b"), ("d2", "a")]


def test_nothing_matched_is_nothing(source):
    put, run, tmp_path = source
    put([("d1", "a", 1, False)])
    assert run() == []
    put([("d0", "a", 2, True)])
    assert run() == [("d0", "a")]


def test_files_before_and_behind_are_left_out(source):
    put, _, tmp_path = source
    for day in "1234":
        put([(f"d{day}", x, int(day) * 10 + i, True) for i, x in enumerate("abc")], 1)
    reader = cursor.CursorReader(type("S", (), {"names": ["day"]}), {"path": f"file://{tmp_path}/rows", "columns": "day,id"})
    assert len(reader.partitions({"place": None}, {"place": ["d4", "c"]})) == 4
    assert len(reader.partitions({"place": ["d1", "c"]}, {"place": ["d3", "a"]})) == 2
    assert reader.partitions({"place": ["d4", "c"]}, reader.latestOffset()) == []
    found = [b.to_pydict()["day"] for p in reader.partitions({"place": ["d2", "b"]}, {"place": ["d3", "a"]}) for b in reader.read(p)]
    assert sorted(x for days in found for x in days) == ["d2", "d3"]
