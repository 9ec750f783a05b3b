"""The backfill of repairs' orders: each step, ambiguous and conflicting pairs, and rows without a serial number."""

import __spark_entry__ as entry
from traceloom.operators import mapping

REPAIR = "repair_id string, PCODE string, AUFNR string, VBELN string, GSTRS string"
STATION = "PCODE string, AUFNR string, KDAUF string"
ORDER = "AUFNR string, VBELN string, gstrs_date date"


def filled(spark, repairs, stations=(), orders=(), **external):
    outer = {k: spark.createDataFrame(v, "PCODE string, AUFNR string") for k, v in external.items()}
    board = spark.createDataFrame(list(orders), "AUFNR string, VBELN string, day string").selectExpr("AUFNR", "VBELN", "cast(day AS date) AS gstrs_date")
    found = mapping.backfill_chain(spark.createDataFrame([(str(i), *r) for i, r in enumerate(repairs)], REPAIR), spark.createDataFrame(list(stations), STATION), board, outer)
    return [tuple(r)[1:] for r in sorted(found.collect(), key=lambda r: int(r.repair_id))]


def test_only_one_complete_pair_of_stations_fills(spark):
    stations = [("SN-1", "P-1", "S-1"), ("SN-1", "P-1", "S-1"), ("SN-2", "P-2", "S-2"), ("SN-2", "P-3", "S-3"), ("SN-3", "", "S-3"), ("", "P-9", "S-9")]
    repairs = [("SN-1", "", "", ""), ("SN-2", "", "", ""), ("SN-3", "", "", ""), ("SN-4", None, None, None), ("SN-1", "P-old", "already", ""), ("", "", "", ""), (None, "", " ", "")]
    nothing = ("", "", "", "", "", "", False)
    assert filled(spark, repairs, stations) == [("P-1", "S-1", "", "stations", "stations", "", False), nothing, nothing, nothing, ("P-old", "already", "", "", "", "", True), nothing, nothing]


def test_an_order_that_is_there_is_never_overwritten(spark):
    assert filled(spark, [("SN-1", "P-old", "  ", ""), ("SN-1", "P-2", "S-2", ""), ("SN-1", "0012", "", "")], [("SN-1", "12", "S-1")]) == [
        ("P-old", "", "", "", "", "", True), ("P-2", "S-2", "", "", "", "", True), ("0012", "S-1", "", "", "stations", "", False),
    ]


def test_repairs_fill_each_other_where_stations_cannot(spark):
    repairs = [("SN-1", "P-1", "S-1", ""), ("SN-1", "", "", ""), ("SN-2", "P-2", "S-2", ""), ("SN-2", "P-3", "S-3", ""), ("SN-2", "", "", "")]
    assert [r[:2] + r[3:5] for r in filled(spark, repairs)] == [("P-1", "S-1", "", ""), ("P-1", "S-1", "repairs", "repairs"), ("P-2", "S-2", "", ""), ("P-3", "S-3", "", ""), ("", "", "", "")]


def test_outer_sources_fill_only_an_empty_order_the_second_where_the_first_has_none(spark):
    repairs = [(f"SN-{i}", "", "", "") for i in range(4)] + [("SN-0", "P", "", "")]
    found = filled(spark, repairs, KK=[("SN-0", "1"), ("SN-2", "5"), ("SN-2", "6")], SG=[("SN-0", "9"), ("SN-1", "2"), ("SN-2", "7")])
    assert [(r[0], r[3]) for r in found] == [("1", "KK"), ("2", "SG"), ("7", "SG"), ("", ""), ("P", "")]


def test_the_board_fills_sales_order_and_start(spark):
    orders = [("123", "S-123", "2026-09-01"), ("77", "S-77", "2026-09-01"), ("077", "S-77", "2026-09-02")]
    found = filled(spark, [("SN-1", "000123", "", ""), ("SN-9", "000123", "S", "2026-01-01"), ("SN-2", "77", "", "")], orders=orders)
    assert found == [("000123", "S-123", "2026-09-01", "", "board", "board", False), ("000123", "S", "2026-01-01", "", "", "", False), ("77", "S-77", "", "", "board", "", False)]


def test_every_step_occurs_in_the_query(spark):
    found = {(r.field, r.source): r.n for r in entry.queries()["repair_backfill_counts"](spark, "/root/testdata/sf0.01").collect()}
    assert set(found) == {("order", s) for s in ("stations", "repairs", "KK", "SG")} | {("sales", s) for s in ("stations", "repairs", "board")} | {("start", "board"), ("conflict", "stations")}
    assert min(found.values()) > 5


def test_rows_without_a_key_are_dealt_out(spark):
    rows = spark.range(1000).selectExpr("cast(id AS string) AS id", "CASE WHEN id % 2 = 0 THEN ' ' END AS k")
    assert rows.select(mapping.spread_key(rows.k, "id").alias("k")).distinct().count() == 1000
