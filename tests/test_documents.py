"""Seek pages, canonical rows of snapshots, device documents, stored layouts."""

import hashlib
import random
from dataclasses import replace

import pytest

from pyspark.sql import functions as F
from traceloom.operators import devices, documents, identity, read
from traceloom.plans import views as v
from traceloom.plans.filters import Filter
from traceloom.sources import layout


@pytest.mark.parametrize("order", [[("a", True), ("b", False), ("id", True)], [("b", False), ("a", True), ("id", False)], [("a", True), ("id", True)]])
def test_pages_together_are_the_whole_order(spark, order):
    rng = random.Random(len(order))
    rows = [(i, rng.choice([None, "", "x", "y", "z"]), rng.choice([None, 1, 2])) for i in range(83)]
    df = spark.createDataFrame(rows, "id int, a string, b int").repartition(3).cache()
    whole = [r.id for r in df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).collect()]
    found, place = [], None
    while page := read.seek(df, order, place, 20).collect():
        found += [r.id for r in page]
        place = {c: page[-1][c] for c, _ in order}
    assert found == whole


def test_a_deep_page_sorts_only_what_is_behind_it(spark, tmp_path):
    spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("a")).write.parquet(f"file://{tmp_path}/rows")
    df = spark.read.parquet(f"file://{tmp_path}/rows")
    plan = read.seek(df, [("id", True)], {"id": 30}, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "LessThan" in plan.split("PushedFilters:")[1].split("]")[0]
    page = read.seek_page(df.selectExpr("cast(id AS string) AS order_id", "CAST(NULL AS date) AS gstrs_date", "id AS last_synced_at", "'SG' AS source"), v.ORDERS, Filter({"source": "SG"}), {"gstrs_date": None, "last_synced_at": 500, "order_id": "500"}, 3)
    assert [r.order_id for r in page.collect()] == ["499", "498", "497"]
    assert read.place_of(df.limit(0), ["id"]) is None


STORED = "id string, identity string, stored_identity string, synced string, digest string, covered boolean, aliases array<string>"


def test_five_stored_rows_three_in_the_source(spark):
    """Two identities were stored twice under old keys, one once: nothing is inserted, two rows go, three remain; a second run changes nothing."""
    stored = spark.createDataFrame([(str(i), k, None, str(i), f"{k}{i}", True, None) for i, k in enumerate(["chain", "chain", "board", "board", "third"])], STORED)
    snapshot = spark.createDataFrame([("chain", "chain1"), ("board", "board3"), ("third", "third4")], "identity string, digest string")
    plan = identity.reconciled(snapshot, stored).cache()
    counts = identity.run_counts(plan).first().asDict()
    assert counts == {"inserted": 0, "updated": 0, "unchanged": 3, "relinked": 3, "deleted": 2, "covered": 3, "outside": 0}
    assert {(r.identity, r.id, tuple(r.aliases)) for r in plan.where("action = 'unchanged'").collect()} == {("chain", "1", ("0", "1")), ("board", "3", ("2", "3")), ("third", "4", ("4",))}
    gone = {r.id for r in identity.deletable(plan.where("action = 'unchanged'").select("identity"), snapshot, plan).collect()}
    assert gone == {"0", "2"}
    kept = plan.where("action = 'unchanged'").join(stored.select("id", "synced", "digest"), "id").select("id", "identity", F.col("identity").alias("stored_identity"), "synced", "digest", F.lit(True).alias("covered"), "aliases")
    again = identity.run_counts(identity.reconciled(snapshot, kept)).first().asDict()
    assert again == {"inserted": 0, "updated": 0, "unchanged": 3, "relinked": 0, "deleted": 0, "covered": 3, "outside": 0}


def test_the_canonical_row_and_its_references(spark):
    rows = [("a", "k", None, "9", "x", True, ["a0"]), ("b", "k", "k", "1", "y", True, None), ("c", "k", "other", "5", "z", False, ["c0", "a0"]), ("n", None, None, "1", "x", True, None), ("o", "gone", "gone", "1", "x", False, None), ("s", "gone2", "gone2", "1", "x", True, None)]
    stored = spark.createDataFrame(rows, STORED)
    snapshot = spark.createDataFrame([("k", "new"), ("fresh", "f")], "identity string, digest string")
    plan = identity.reconciled(snapshot, stored)
    assert sorted((r.identity or "", r.id or "", r.action, r.relinked) for r in plan.collect()) == [
        ("", "n", "stale", False), ("fresh", "", "insert", False), ("gone", "o", "outside", False), ("gone2", "s", "stale", False), ("k", "a", "superseded", False), ("k", "b", "update", False), ("k", "c", "superseded", False),
    ]
    names = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "a0", "c0", "b", "unknown", None])], "n int, repair string")
    assert [r.repair for r in identity.relinked_references(names, plan, "repair").orderBy("n").collect()] == ["b", "b", "b", "b", "unknown", None]


def test_nothing_is_deleted_before_all_is_written(spark):
    stored = spark.createDataFrame([(str(i), f"k{i}", f"k{i}", "1", "x", True, None) for i in range(210)], STORED)
    snapshot = spark.createDataFrame([(f"k{i}", "x") for i in range(60)], "identity string, digest string")
    plan = identity.reconciled(snapshot, stored)
    with pytest.raises(ValueError, match="isn't written whole"):
        identity.deletable(snapshot.limit(59), snapshot, plan)
    with pytest.raises(ValueError, match="isn't written whole"):
        identity.deletable(snapshot.limit(59).union(spark.createDataFrame([("other", "x")], snapshot.schema)), snapshot, plan)
    with pytest.raises(ValueError, match="150 of 210"):
        identity.deletable(snapshot, snapshot, plan)
    assert identity.deletable(snapshot, snapshot, plan, override=True).count() == 150
    none = snapshot.limit(0)
    with pytest.raises(ValueError, match="would go"):
        identity.deletable(none, none, identity.reconciled(none, stored.limit(3)))


DECLARATION = "doa_code string, doa_judge string, status string, service_uid string, sales_order string, equipment array<struct<product string, material_sn string, context_value string, factory_date string, production_order string, sales_order string, model string, factory_equipment string, warranty_equipment string, warranty_product string>>"


def declared(spark):
    one = ("HOST-1", "PART-1", "C1", "2026-01-01", "PO-1", "SO-1", None, "", "", "2029-01-01")
    other = ("HOST-2", "PART-3", "C3", "2026-02-01", "PO-2", "SO-2", "M", None, "2029-02-01", "2029/02/01 10:00")
    two = ("HOST-1", "PART-2", "C2", "20260101", "PO-1", "SO-1", " ", "2026-02-30", None, "2030-01-01")
    rows = [("D1", "yes", "open", "XNC1", "SO-1", [other, one]), ("D2", "no", "open", " XH2", "SO-9", [two, (None,) * 10, (None, "PART-9", None, *(None,) * 7)]), ("D3", "no", "open", None, None, []), ("D4", "no", "open", None, None, None)]
    return spark.createDataFrame(rows, DECLARATION)


def test_device_documents(spark):
    found = {r.device: r for r in devices.documents(devices.pieces(declared(spark))).collect()}
    assert set(found) == {"product:HOST-1", "product:HOST-2", "unidentified:D2:1", "material:PART-9"}
    host = found["product:HOST-1"]
    assert [(e.doa_code, e.context, e.material_sn, e.sales_order_relation, e.serial_relation) for e in host.evidence] == [("D1", "C1", "PART-1", "same", "different"), ("D2", "C2", "PART-2", "different", "different")]
    assert (host.basis, host.n_pieces, host.part, host.sales_order.value, host.production_order.value) == ("product_barcode", 2, 0, "SO-1", "PO-1")
    assert host.warranty_end.asDict() == {"status": "conflict", "value": None, "candidates": ["2029-01-01", "2030-01-01"], "invalid": []}
    assert (host.factory_date.status, host.factory_date.candidates, host.factory_date.invalid, host.model.status) == ("invalid", ["2026-01-01"], ["2026-02-30"], "missing")
    assert found["product:HOST-2"].warranty_end.value == "2029-02-01" and found["product:HOST-2"].model.value == "M"
    assert found["unidentified:D2:1"].basis == "missing" and found["material:PART-9"].evidence[0].serial_relation == "missing"


@pytest.mark.parametrize(("wanted", "hits"), [
    ({"company": "yes"}, {"product:HOST-1", "product:HOST-2"}), ({"company": "no"}, {"product:HOST-1", "unidentified:D2:1", "material:PART-9"}), ({"company": "maybe", "serial": "PART-9"}, {"material:PART-9"}),
    ({"sales_order": "SO-9"}, {"product:HOST-1", "unidentified:D2:1", "material:PART-9"}), ({"service_order": "XH2", "serial": "HOST-1"}, {"product:HOST-1"}), ({"company": "yes", "serial": "PART-2"}, set()),
])
def test_one_piece_must_meet_the_whole_filter(spark, wanted, hits):
    assert {r.device for r in devices.documents(devices.pieces(declared(spark)), devices.DeviceFilter(**wanted)).collect()} == hits


@pytest.mark.parametrize(("values", "status", "value"), [([], "missing", None), (["2026-02-30"], "invalid", None), (["2026-01-02 00:00", "20260102"], "valid", "2026-01-02"), (["2026-01-02T01:00:00+08:00", " "], "valid", "2026-01-02"), (["2026/01/02 03:04", "bad"], "invalid", None), (["2026-01-02", "2026-01-03", "bad"], "conflict", None), ([None, ""], "missing", None)])
def test_resolved_days(spark, values, status, value):
    row = spark.createDataFrame([(values,)], "x array<string>").select(devices.resolved(F.col("x"), True).alias("r")).first().r
    assert (row.status, row.value) == (status, value)


def test_a_device_with_many_pieces_comes_in_parts(spark):
    piece = ("H", "M", "C", None, None, None, None, None, None, None)
    rows = spark.createDataFrame([(f"D{i}", "no", "s", None, None, [piece]) for i in range(100)] + [("E", "no", "s", None, None, [("K", *piece[1:])])], DECLARATION)
    found = devices.documents(devices.pieces(rows), part=20).collect()
    hot = [r for r in found if r.device == "product:H"]
    assert len(hot) > 2 and all(len(r.evidence) < 50 and r.n_pieces == 100 for r in hot) and sorted(e.doa_code for r in hot for e in r.evidence) == sorted(f"D{i}" for i in range(100))
    assert [len(r.evidence) for r in found if r.device == "product:K"] == [1]


@pytest.fixture(scope="module")
def boards(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('layout')}"
    rows = spark.range(400).selectExpr("id", "CASE WHEN id % 9 = 0 THEN ' ' WHEN id % 9 = 1 THEN NULL ELSE lpad(cast(id % 50 AS string), 12, '0') END AS AUFNR", "date_add(DATE '2024-01-15', cast(id % 90 AS int)) AS day")
    orders = spark.range(0, 40, 2).selectExpr("cast(id AS string) AS AUFNR", "date_add(DATE '2024-01-15', cast(id AS int)) AS day", "concat('S', id) AS VBELN")
    return layout.ingest(rows, root, "rows", "day", {"order_key": "AUFNR"}, "order_key", 4), layout.ingest(orders, root, "orders", "day", {"order_key": "AUFNR", "sales_key": "VBELN"}, "order_key", 4)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_prune_months_and_reach_the_scan(spark, boards):
    rows, _ = boards
    found = rows.where(layout.in_months("day", "2024-02-10", "2024-02-20"))
    plan = plan_of(found)
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0] and "day" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert all("month=2024-02" in f for f in found.inputFiles()) or len(found.inputFiles()) > 0
    assert found.count() == spark.range(400).where("date_add(DATE '2024-01-15', cast(id % 90 AS int)) BETWEEN DATE '2024-02-10' AND DATE '2024-02-20'").count()
    assert rows.where(layout.in_months("day", None, None)).count() == 400


@pytest.mark.parametrize("yes", [True, False])
def test_board_joins_need_no_exchange(spark, boards, yes):
    rows, orders = boards
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = layout.on_board(rows, orders, "order_key", yes)
        assert "Exchange" not in plan_of(found)
        ids = {r.id for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    on = {i for i in range(400) if i % 9 > 1 and i % 50 < 40 and i % 50 % 2 == 0}
    assert ids == (on if yes else set(range(400)) - on)


def test_unique_values_need_no_exchange(spark, boards):
    rows, orders = boards
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = rows.join(layout.only_value(orders, "order_key", "sales_key"), "order_key")
        assert "Exchange" not in plan_of(joined)
        assert {r.sales_key for r in joined.where("AUFNR = lpad('4', 12, '0')").collect()} == {"S4"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_filtered_board_prunes_months_of_the_other_side(spark, boards):
    rows, orders = boards
    joined = rows.join(orders.where("VBELN = 'S2'").select("month", F.col("order_key").alias("k")), "month")
    assert "dynamicpruning" in plan_of(joined)
    assert {r.month for r in joined.collect()} == {"2024-01"}


def test_a_bucket_has_one_file_a_month(boards):
    rows, _ = boards
    files = [f.rsplit("/", 2)[1:] for f in rows.inputFiles()]
    assert len(files) <= 4 * 4 and len({(m, f.split("_")[-1]) for m, f in files}) == len(files)


def test_counts_come_from_footers(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "timestamp_seconds(1700000000 + id) AS synced_at", "repeat('x', 50) AS text")
    layout.with_load_time(rows, "synced_at").write.parquet(f"file://{tmp_path}/rows")
    found = layout.from_footers(spark, f"file://{tmp_path}/rows")
    assert layout.version(found, "rows").collect()[0].version == "100:2023-11-14 22:14:59"
    plan = plan_of(layout.version(found, "rows"))
    assert "PushedAggregation: [COUNT(*), MAX(synced_us)]" in plan
    assert "PushedAggregation" not in plan_of(layout.version(spark.read.parquet(f"file://{tmp_path}/rows"), "rows"))
    assert tuple(layout.status(found.where("id < 0"), "rows").collect()[0]) == ("rows", 0, None)


def test_a_bulk_read_is_whole_beyond_the_limit_of_its_view(spark):
    rows = spark.createDataFrame([(f"D{i}", f"2024-01-0{i}", "yes") for i in range(1, 6)], "doa_code string, declare_time string, doa_judge string")
    view = replace(v.DECLARATIONS, limit=2)
    found = read.bulk(rows, view, Filter({"judgment": "yes"})).collect()
    assert [(r.doa_code, r.total) for r in found] == [(f"D{i}", 5) for i in (5, 4, 3, 2, 1)]
    assert [(r.doa_code, r.total) for r in read.bulk(rows, view, Filter({"judgment": "yes"}), most=2).collect()] == [("D5", 5), ("D4", 5)]


def test_option_lists_have_every_value_unless_a_cap_is_given(spark):
    rows = spark.range(20_500).selectExpr("cast(id AS string) AS KUNNR", "concat(' x', id % 3) AS CPX")
    assert {r.name: r.n for r in documents.option_lists(rows, ["KUNNR", "CPX"]).groupBy("name").agg(F.count("*").alias("n")).collect()} == {"KUNNR": 20_500, "CPX": 3}
    with pytest.raises(ValueError, match="more than 20000"):
        documents.option_lists(rows, ["KUNNR", "CPX"], cap=20_000)


def many_parts(spark):
    """20,050 pieces of one device over several batches, and three of others; equal pieces count each."""
    piece = "named_struct('product', CASE WHEN id < 20050 THEN 'H' END, 'material_sn', 'M', 'context_value', concat('C', id), 'factory_date', IF(id % 2 = 0, '2026-01-02', '20260102'), 'production_order', concat('PO', id % 9000), 'sales_order', CAST(NULL AS string), 'model', ' ', 'factory_equipment', IF(id = 7, 'soon', ''), 'warranty_equipment', '', 'warranty_product', '2027-01-01')"
    return spark.range(0, 20_053, 1, 3).selectExpr("concat('D', id % 15000) AS doa_code", "'no' AS doa_judge", "'s' AS status", "IF(id = 20050, 'XNC1', 'U') AS service_uid", "'SO' AS sales_order", "1 AS place", f"{piece} AS e")


def test_a_device_of_many_pieces_is_one_row_of_a_summary(spark):
    found = devices.pieces_of(many_parts(spark))
    rows = {r.device: r for r in devices.summaries(found, F.concat_ws("|", "doa_code", "context")).collect()}
    assert set(rows) == {"product:H", "context:C20050", "context:C20051", "context:C20052"}
    hot = rows["product:H"]
    lines = sorted(f"D{i % 15000}|C{i}" for i in range(20_050))
    assert (hot.n_pieces, hot.basis, hot.digest) == (20_050, "product_barcode", hashlib.md5(";".join(lines).encode()).hexdigest())
    assert (hot.production_order.status, hot.production_order.candidates) == ("conflict", sorted(f"PO{i}" for i in range(9000)))
    assert hot.factory_date.asDict() == {"status": "invalid", "value": None, "candidates": ["2026-01-02"], "invalid": ["soon"]}
    assert hot.warranty_end.value == "2027-01-01" and hot.model.asDict() == {"status": "missing", "value": None, "candidates": [], "invalid": []}
    assert [r.device for r in devices.summaries(found, F.col("doa_code"), devices.DeviceFilter(company="yes")).collect()] == ["context:C20050"]


def test_a_page_of_devices_is_found_before_any_documents(spark):
    found = devices.pieces_of(many_parts(spark))
    first = devices.page_devices(found, size=2)
    assert first == ["context:C20050", "context:C20051"] and devices.page_devices(found, first[-1], 2) == ["context:C20052", "product:H"]
    assert devices.page_devices(found, "product:H") == [] and devices.page_devices(found, wanted=devices.DeviceFilter(company="yes")) == ["context:C20050"]
