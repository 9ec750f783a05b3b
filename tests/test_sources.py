"""The dated source and the export, as Spark data sources."""

import json
import threading
from dataclasses import replace
from datetime import date
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest

from pyspark.sql import functions as F
from traceloom import queries
from traceloom.plans import views as v
from traceloom.plans.filters import Filter
from traceloom.sources import dated, export

SCHEMA = "AUFNR string, n string, more string, posted date, asked_from date"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    spark.dataSource.register(dated.DatedRows)
    spark.dataSource.register(export.Export)
    root = tmp_path_factory.mktemp("answers")
    rows = [(f"{i % 9:012d}", i, date(2024, 1, 1 + i % 20), "SG" if i % 2 else "KK") for i in range(400)]
    df = spark.createDataFrame(rows, "AUFNR string, n long, posted date, source string")
    dated.record(df.select("AUFNR", "n", "posted"), F.col("posted"), F.expr("CASE WHEN n % 2 = 1 THEN 'SG' ELSE 'KK' END"), f"file://{root}/all", most=4)
    return f"file://{root}/all", rows


def read(spark, url, **options):
    reader = spark.read.format("dated_rows").schema(SCHEMA).option("url", url).option("source", "SG")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_windows_are_partitions_and_the_last_is_cut(spark, store):
    url, rows = store
    found = read(spark, url, start="2024-01-02", end="2024-01-20")
    assert found.rdd.getNumPartitions() == 3
    assert sorted((r.AUFNR, int(r.n), r.posted) for r in found.collect()) == sorted((a, n, d) for a, n, d, s in rows if s == "SG" and d >= date(2024, 1, 2))
    assert {(r.asked_from, r.more) for r in found.collect()} == {(date(2024, 1, d), None) for d in (2, 9, 16)}
    assert [(w.first.day, w.last.day) for w in dated.windows(date(2024, 1, 2), date(2024, 1, 20), 7)] == [(2, 8), (9, 15), (16, 20)]
    assert [(w.first, w.last) for w in dated.windows(date(2024, 1, 2), date(2024, 1, 2), 7)] == [(date(2024, 1, 2),) * 2]


def test_days_without_answers_are_empty(spark, store):
    assert read(spark, store[0], start="2023-01-01", end="2023-01-03").count() == 0


def test_one_order_with_or_without_zeros(spark, store):
    url, rows = store
    wanted = sorted(n for a, n, _, s in rows if s == "SG" and a.endswith("7"))
    for order in ("7", "0007", " 000000000007 "):
        assert sorted(int(r.n) for r in read(spark, url, start="2024-01-01", end="2024-01-31", most_days="31", order=order).collect()) == wanted
    assert dated.bare("000A1") == "A1" and dated.bare("000") == "0" and dated.bare(None) == ""


@pytest.mark.parametrize(("options", "said"), [({"start": "2024-01-01", "end": "2024-02-01", "most_days": "31"}, "more than 31 days"), ({"start": "2024-01-02", "end": "2024-01-01"}, "empty"), ({"start": "2024-01-01", "end": "2024-01-02", "order": "1" * 41}, "too long")])
def test_bad_questions(spark, store, options, said):
    with pytest.raises(Exception, match=said):
        read(spark, store[0], **options).collect()


def test_filters_on_the_day_ask_for_less(spark, store):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = read(spark, store[0], start="2024-01-01", end="2024-01-20", days="1", day="posted").where("posted >= DATE '2024-01-05' AND posted < DATE '2024-01-09'")
        assert found.rdd.getNumPartitions() == 5
        assert {r.posted.day for r in found.collect()} == {6, 8}
        none = read(spark, store[0], start="2024-01-01", end="2024-01-20", day="posted").where("posted = DATE '2025-01-05'")
        assert none.count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("answer", ['{"MSGTY": "E", "MSGTX": "locked"}', '{"MSGTY": "x", "MSGTX": "down", "DATA": []}', '{"MSGTY": "S"}', '{"MSGTY": "S", "DATA": null}', '{"MSGTY": "S", "DATA": {"a": 1}}', '{"MSGTY": "S", "DATA": [1]}', "[]"])
def test_wrong_answers_fail_the_read(spark, tmp_path, answer):
    folder = tmp_path / "source=SG" / "day=2024-01-03"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"MSGTY": "S", "DATA": [{"AUFNR": "1"}]}\n' + answer + "\n")
    with pytest.raises(Exception, match="answer|source says"):
        read(spark, f"file://{tmp_path}", start="2024-01-01", end="2024-01-07").collect()


def test_an_answer_without_data_is_empty(spark, tmp_path):
    folder = tmp_path / "source=SG" / "day=2024-01-03"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"MSGTY": "E", "MSGTX": "No Data found"}\n{"MSGTY": "A", "MSGTX": "无数据"}\n')
    assert read(spark, f"file://{tmp_path}", start="2024-01-01", end="2024-01-07").count() == 0


def test_lines_end_only_where_they_do(spark, tmp_path):
    rows = spark.createDataFrame([("a\u2028b\x85c\rd\ne", date(2024, 1, 3))], "AUFNR string, posted date")
    dated.record(rows, F.col("posted"), F.lit("SG"), f"file://{tmp_path}/in")
    assert [r.AUFNR for r in read(spark, f"file://{tmp_path}/in", start="2024-01-01", end="2024-01-07").collect()] == ["a\u2028b\x85c\rd\ne"]


def test_a_service_is_asked_window_by_window(spark, store):
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((body["CHDAT"], body["CHDAT_TO"]))
            data = json.dumps({"MSGTY": "S", "DATA": [{"AUFNR": body["CHDAT"], "n": {"x": 1}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        found = read(spark, f"http://127.0.0.1:{server.server_port}/rows", start="2024-01-01", end="2024-01-10").collect()
    finally:
        server.shutdown()
    assert sorted(r.AUFNR for r in found) == ["2024-01-01", "2024-01-08"] and found[0].n == '{"x": 1}'
    assert sorted(seen) == [("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-10")]


def put(df, path, **options):
    writer = df.write.format("export").option("path", f"file://{path}")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.mode("append").save()


def test_export_is_in_order_with_headers(spark, store, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n"), F.concat(F.lit("a\tb\n"), "id").alias("text"), F.when(F.col("id") % 2 == 0, F.lit(2.5)).alias("x"))
    put(df.repartitionByRange(4, F.desc("n")).sortWithinPartitions(F.desc("n")), tmp_path / "out", labels="Number,Text,X", limit="1000")
    files = sorted((tmp_path / "out").glob("part-*.tsv"))
    lines = [line for f in files for line in f.read_text().splitlines()[1:]]
    assert [int(line.split("\t")[0]) for line in lines] == list(range(999, -1, -1))
    assert all(f.read_text().startswith("﻿Number\tText\tX\n") for f in files) and len(files) > 1
    assert all(line.split("\t")[1].startswith("a b ") and line.split("\t")[2] in ("", "2.5") for line in lines)


def test_over_the_limit_or_failed_leaves_nothing(spark, store, tmp_path):
    with pytest.raises(Exception, match="more than 9"):
        put(spark.range(10), tmp_path / "out", limit="9")
    failing = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("bad row")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="bad row"):
        put(failing, tmp_path / "out")
    assert list(tmp_path.iterdir()) == []
    put(spark.range(10), tmp_path / "out", limit="10")
    with pytest.raises(Exception, match="there already"):
        put(spark.range(10), tmp_path / "out")
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_export_of_nothing_has_a_header(spark, store, tmp_path):
    put(spark.range(0), tmp_path / "out")
    files = list(Path(tmp_path / "out").iterdir())
    assert len(files) <= 1 and all(f.read_text() == "﻿id\n" for f in files)


def test_csv_cells():
    cells = {"=1": "'=1", "-x": "'-x", "-5": "-5", 'a"b': '"a""b"', "x,y": '"x,y"', None: "", True: "true", 2.0: "2", 0.1: "0.1", date(2024, 1, 2): "2024-01-02"}
    assert {k: export.csv_cell(k) for k in cells} == cells


def test_an_export_of_a_view_is_whole_beyond_its_limit(spark, store, tmp_path):
    rows = spark.range(50).selectExpr("concat('D', id) AS doa_code", "cast(id + 100 AS string) AS declare_time", "'F' AS status")
    view, wanted = replace(v.DECLARATIONS, limit=9), Filter({"status": "F"})
    export.export_view(rows, view, wanted, ["doa_code"], f"file://{tmp_path}/out")
    lines = [line for f in sorted((tmp_path / "out").iterdir()) for line in f.read_text().splitlines()[1:]]
    assert lines == [f"D{i}" for i in range(49, -1, -1)]
    with pytest.raises(Exception, match="more than 9"):
        export.export_view(rows, view, wanted, ["doa_code"], f"file://{tmp_path}/other", limit=9)


def test_the_export_of_station_passes_is_whole_beyond_the_limit_of_their_view(spark, monkeypatch):
    monkeypatch.setattr(v, "STATIONS", replace(v.STATIONS, limit=3))
    assert queries.export_newest_first(spark, "/root/testdata/sf0.001").count() > 3
