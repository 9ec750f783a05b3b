"""The library's operators on small rows with known results."""

import pytest

from pyspark.sql import functions as F
from traceloom.functions import scalars as s
from traceloom.operators import incremental, mapping, read, reconcile, rollup, runs
from traceloom.plans import views as v
from traceloom.plans.filters import Filter, bounded_predicate, lookup_predicate, predicate
from traceloom.sources import html, sinks
from traceloom.streaming import passes


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_order_numbers(spark):
    assert values(spark, s.norm_order("x"), ["000123", "000ABC", "0", "000", " 12 ", None]) == ["123", "000ABC", "0", "0", "12", None]
    assert values(spark, s.station_order("x"), ["00000123", "000", " 123 ", "AB-123", "", None]) == ["123", "0", "123", None, None, None]
    assert s.order_candidates("0000456", 12) == ["0000456", "456", "000000000456"]
    assert s.order_candidates("AB", 10) == ["AB"] and s.split_values("a，b, a,,") == ["a", "b"]


def test_numbers_flags_and_dates(spark):
    assert values(spark, s.number("x"), [None, "1,234.50", "bad", "2", "NaN", "Infinity"]) == [0, 1234.5, 0, 2, 0, 0]
    assert values(spark, s.optional_number("x"), ["not-a-number", "0", ""]) == [None, 0, None]
    assert values(spark, s.optional_flag("x"), ["true", "否", "1", "0", "unknown", None]) == [True, False, True, False, None, None]
    dates = values(spark, F.date_format(s.parse_date("x"), "yyyy-MM-dd"), ["2026-01-02", "20260102", "2026-02-30", "2026/03/04", "2026-01-02 00:00", "", None])
    assert dates == ["2026-01-02", "2026-01-02", None, "2026-03-04", "2026-01-02", None, None]
    assert values(spark, s.iso_date("x"), ["20260102", "2026-01-02", "x"]) == ["2026-01-02", "2026-01-02", "x"]


def test_windows(spark):
    bounds = values(spark, F.date_format(s.rolling_start(F.col("x").cast("date"), 3, "2026-01-01"), "yyyy-MM-dd"), ["2026-10-14", "2027-01-31", "2026-02-28"])
    assert bounds == ["2026-08-01", "2026-11-01", "2026-01-01"]
    found = [tuple(map(str, r)) for r in incremental.day_windows(spark, "2026-01-01", "2026-01-16", 7).collect()]
    assert found == [("2026-01-01", "2026-01-07"), ("2026-01-08", "2026-01-14"), ("2026-01-15", "2026-01-16")]


def test_company_prefix_and_cells(spark):
    flag = s.company_flag(F.lit(None).cast("string"), F.col("x"))
    assert values(spark, flag, ["XNC251957", " xnc2519580 ", "XHG2609190", "PREFIX-XNC2519570", "", None]) == [True, True, False, False, False, False]
    assert values(spark, s.safe_cell("x"), ["=1", "+a", "-5", "-x", "@b", "plain", None]) == ["'=1", "'+a", "-5", "'-x", "'@b", "plain", ""]


def test_filters(spark):
    rows = spark.createDataFrame([("r1", "P1", "000012", "2026-01-02"), ("r2", "P2", None, None)], "repair_id string, PCODE string, AUFNR string, day string").withColumn("gstrs_date", F.col("day").cast("date"))
    ids = lambda f: sorted(r.repair_id for r in rows.where(predicate(v.REPAIRS, f)).collect())
    assert ids(Filter()) == ["r1", "r2"]
    assert ids(Filter({"production_order": "12"})) == [] and ids(Filter({"production_order": "000012"})) == ["r1"]
    assert ids(Filter({"sn": " , "})) == ["r1", "r2"]
    assert ids(Filter(first_day="2026-01-02", last_day="2026-01-02")) == ["r1"] and ids(Filter(missing=("AUFNR",))) == ["r2"]
    assert rows.where(lookup_predicate(v.REPAIRS, Filter())).count() == 0
    assert [r.repair_id for r in rows.where(s.not_in("AUFNR", ["000012"])).collect()] == ["r2"]
    with pytest.raises(ValueError):
        bounded_predicate(v.POSTINGS, Filter())
    with pytest.raises(ValueError):
        predicate(v.REPAIRS, Filter({"nothing": "x"}))


def test_pages_are_disjoint_and_whole(spark):
    rows = spark.range(205).selectExpr("format_string('KK:%04d', id) AS order_id", "DATE '2026-01-01' AS gstrs_date", "TIMESTAMP_NTZ '2026-01-01 00:00:00' AS last_synced_at", "id + 1 AS WMENG")
    found = [r for n in range(1, 7) for r in read.page(rows, v.ORDERS, Filter(), n, 37).collect()]
    assert len({r.order_id for r in found}) == len(found) == 205 and sum(r.WMENG for r in found) == 205 * 206 // 2
    assert [r.order_id for r in found] == sorted((r.order_id for r in found), reverse=True)
    assert [r.has_more for r in read.preview(rows, v.ORDERS, Filter(), 3).collect()] == [True] * 3


def test_detail_by_any_key(spark):
    rows = spark.createDataFrame([("r1", ["old", "merged"]), ("r2", None)], "repair_id string, former array<string>")
    assert all(read.detail(rows, ["repair_id", "former"], k).first().repair_id == "r1" for k in ("r1", "old", "merged"))
    with pytest.raises(ValueError):
        read.export_rows(rows, spark, "repair_id", ["r1", "r2"], 1)


def test_station_cleaning(spark):
    orders = spark.createDataFrame([("1", "SO-1"), ("2", "SO-2"), ("2", "SO-3")], "AUFNR string, VBELN string")
    stations = spark.createDataFrame([("a", "1", ""), ("b", "999", ""), ("c", "2", ""), ("d", "9", "SO-X"), ("e", "1", "SO-1"), ("f", "", ""), ("g", " ", "SO-1")], "HISTROYID string, AUFNR string, KDAUF string")
    found = {r.HISTROYID: (r.action, r.AUFNR, r.KDAUF) for r in mapping.fill_stations(stations, orders).collect()}
    assert found == {"a": ("fill_sales", "1", "SO-1"), "b": ("unresolved", "999", ""), "c": ("ambiguous", "2", ""), "d": ("delete", "9", "SO-X"), "e": ("keep", "1", "SO-1"), "f": ("unresolved", "", ""), "g": ("fill_production", "1", "SO-1")}


def test_backfill(spark):
    stations = spark.createDataFrame([("SN-1", "P-1", "S-1"), ("SN-1", "P-1", "S-1"), ("SN-2", "P-2", "S-2"), ("SN-2", "P-3", "S-3"), ("SN-3", "", "S-3")], "PCODE string, AUFNR string, KDAUF string")
    repairs = spark.createDataFrame([("r1", "SN-1", "", "", None), ("r2", "SN-2", "", "", None), ("r3", "SN-3", "", "", None), ("r4", "SN-4", "", "", None), ("r5", "SN-1", "P-old", "already", None), ("r6", "SN-9", "000123", "", "")], "repair_id string, PCODE string, AUFNR string, VBELN string, GSTRS string")
    orders = spark.createDataFrame([("123", "S-9", "2026-01-05")], "AUFNR string, VBELN string, gstrs_date string")
    external = spark.createDataFrame([("SN-4", "P-4")], "PCODE string, AUFNR string")
    found = {r.repair_id: (r.AUFNR, r.VBELN, r.GSTRS, r.step) for r in mapping.backfill_repairs(repairs, stations, orders, external).collect()}
    assert found["r1"] == ("P-1", "S-1", "", "stations") and found["r2"] == ("", "", "", "") and found["r3"] == ("", "", "", "")
    assert found["r4"] == ("P-4", "", "", "") and found["r5"] == ("P-old", "already", "", "") and found["r6"] == ("000123", "S-9", "2026-01-05", "")


def test_roll_up(spark):
    lines = spark.createDataFrame([("SG", "100", "1", "1,000", "2", "Model-ww", "X", "2026-01-02"), ("SG", "100", "2", "2", "3", "Plain", "Y", "20260103"), ("SG", "", "3", "9", None, None, None, None)], "source string, AUFNR string, position string, GAMNG string, WMENG string, MAKTX string, ZSTAT string, GSTRS string")
    row = rollup.order_documents(lines).collect()
    assert len(row) == 1 and tuple(row[0])[2:] == (2, 1002.0, 5.0, "Plain", "Y", "2026-01-03", True)
    assert rollup.with_records(lines).first().records[0].GAMNG == "1,000"


def test_date_evidence(spark):
    rows = spark.createDataFrame([(1, []), (2, ["2026-02-30"]), (3, ["2026-01-02 00:00", "20260102"]), (4, ["2026-01-02", "2026-01-03"]), (5, [None, ""])], "i int, d array<string>")
    found = [r.x for r in rows.orderBy("i").select(rollup.resolved_dates(F.col("d")).alias("x")).collect()]
    assert found == ["missing", "invalid", "valid", "conflict", "missing"]


def test_reconcile(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, x string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "k string, x string")
    actions = reconcile.classify(new, old, ["k"], ["x"])
    assert {r.k: r.action for r in actions.collect()} == {"a": "unchanged", "b": "update", "c": "stale", "d": "insert"}
    assert [r.k for r in reconcile.guarded(actions).collect()] == ["c"]
    with pytest.raises(ValueError):
        reconcile.guarded(reconcile.classify(new.limit(0), old, ["k"], ["x"]))
    assert reconcile.guarded(reconcile.classify(new.limit(0), old, ["k"], ["x"]), override=True).count() == 3
    stored = old.withColumns({"first_seen": F.lit("t0"), "last_synced": F.lit("t0"), "sync_count": F.lit(1)})
    once = reconcile.upserted(stored, new, ["k"], ["x"], "t1")
    again = reconcile.upserted(once, new, ["k"], ["x"], "t2")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
    assert {r.k: (r.x, r.first_seen, r.last_synced, r.sync_count) for r in once.collect()} == {"a": ("1", "t0", "t0", 1), "b": ("9", "t0", "t1", 2), "c": ("3", "t0", "t0", 1), "d": ("4", "t1", "t1", 1)}
    with pytest.raises(ValueError):
        reconcile.require_no_conflict(old.union(new), ["k"], ["x"])
    assert {(r.k, r.kind, r.fields) for r in reconcile.differences(new, old, ["k"], ["x"]).collect()} == {("b", "field_mismatch", "x"), ("c", "extra", ""), ("d", "missing", "")}


def test_html(spark):
    page = '<form id="f"><table><tr><th name="doa_code">Code</th><th name="status">State</th></tr><tr value="c1"><td> D&amp;1 </td><td>open\n now</td></tr></table></form><table><tr><th>Order:</th><td>SO-1</td></tr></table>'
    rows = spark.createDataFrame([(page,), (None,)], "html string")
    found = rows.select(html.table_rows(F.col("html"), "f").alias("r"), html.label_values(F.col("html")).alias("l")).collect()
    assert found[0].r == [{"doa_code": "D&1", "status": "open now"}] and found[0].l["Order"] == "SO-1" and found[1].r == []
    short = spark.createDataFrame([(page.replace("<td>open\n now</td>", ""),)], "html string")
    with pytest.raises(Exception, match="too few cells"):
        short.select(html.table_rows(F.col("html"), "f")).collect()
    picked = rows.limit(1).select(F.explode(html.table_rows(F.col("html"), "f")).alias("r")).select(*html.aliased(F.col("r"), {"code": ["none", "doa_code"]})).first()
    assert picked.code == "D&1"


def test_versions_and_streams(spark, tmp_path):
    root = f"file://{tmp_path}/data"
    sinks.write_version(spark.range(3), root, 1)
    sinks.write_version(spark.range(5), root, 2)
    assert sinks.read_latest(spark, root).count() == 5
    events = spark.range(4).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2026-01-01 00:00:00' AS ts", "id AS user_id", "'a' AS event_type", "1.0D AS value", "'{}' AS props")
    events.union(events).write.parquet(f"{tmp_path}/events")
    out = (f"{tmp_path}/out", f"{tmp_path}/marks")
    passes.run_available(passes.first_passes(passes.event_stream(spark, f"{tmp_path}/events")), *out)
    passes.run_available(passes.first_passes(passes.event_stream(spark, f"{tmp_path}/events")), *out)
    assert spark.read.parquet(out[0]).count() == 4


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id AS string) AS repair_id", "concat('P', id) AS PCODE", "'x' AS other").write.parquet(f"{tmp_path}/r")
    rows = spark.read.parquet(f"{tmp_path}/r").where(predicate(v.REPAIRS, Filter({"sn": "P1,P2"}))).select("repair_id")
    plan = rows._jdf.queryExecution().toString()
    assert "In(PCODE" in plan.split("PushedFilters")[1] and "other" not in plan.split("ReadSchema")[-1]


def test_rows_out_of_the_window_fail_the_run(spark):
    rows = spark.createDataFrame([("a", "2026-01-02"), ("b", "2026-02-30")], "k string, d string")
    day = s.parse_date("d")
    assert runs.require_in_window(rows.where("k = 'a'"), day, "2026-01-01", "2026-01-31").count() == 1
    with pytest.raises(Exception, match="out of the window"):
        runs.require_in_window(rows, day, "2026-01-01", "2026-01-31").collect()


def test_strict_flags_and_other_days(spark):
    rows = spark.createDataFrame([("a", True, "2024-01-02"), ("b", False, "2024-01-05"), ("c", None, None)], "k string, is_company boolean, day string").withColumn("day", F.col("day").cast("date"))
    hits = lambda **w: {r.k for r in rows.where(predicate(v.DECLARATIONS, Filter(**w))).collect()}
    assert hits(strict_flags={"is_company": "yes"}) == {"a"} and hits(strict_flags={"is_company": "unknown"}) == {"b"} and hits(strict_flags={"is_company": " "}) == {"a", "b", "c"}
    assert hits(flags={"is_company": "unknown"}) == {"a", "b", "c"}
    assert hits(days={"day": ("2024-01-03", None)}) == {"b"} and hits(days={"day": (None, "2024-01-03")}) == {"a"}
    assert Filter(strict_flags={"x": "n"}).is_bounded() and Filter(days={"day": (None, "2024-01-01")}).is_bounded() and not Filter(days={"day": (None, None)}).is_bounded()


def test_a_source_scan_without_orders_reads_nothing(spark):
    rows = spark.createDataFrame([("1", "7"), ("2", None)], "id string, AUFNR string")
    spec = incremental.SourceSpec(("id",), None, None, None, ("id",))
    assert [r.id for r in incremental.source_scan(rows, spec).collect()] == ["1", "2"]
    assert incremental.source_scan(rows, spec, orders=[]).count() == 0 and [r.id for r in incremental.source_scan(rows, spec, orders=["7"]).collect()] == ["1"]
    with pytest.raises(ValueError):
        incremental.source_scan(rows, spec, "often")
