"""Joins that fill a value only where it is the only one, and the filters by another dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.scalars import blank, company_flag, norm_order, text


def spread_key(key: Column, row_id: Column | str) -> Column:
    """The key of the left side of a left join; rows without one get keys of their own, which meet nothing, so they aren't dealt to one place."""
    return F.coalesce(text(key), F.concat(F.lit("\u0000"), F.col(row_id) if isinstance(row_id, str) else row_id))


def unique_map(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, candidates): how many different values a key has; the value only where it is one. Blanks take no part."""
    pairs = rows.select(key.alias("key"), text(value).alias("value")).where("key IS NOT NULL AND key != '' AND value IS NOT NULL")
    counted = pairs.groupBy("key").agg(F.count_distinct("value").alias("candidates"), F.min("value").alias("least"))
    return counted.select("key", F.when(F.col("candidates") == 1, F.col("least")).alias("value"), "candidates")


def unique_maps(rows: DataFrame, key: Column, values: dict[str, Column]) -> DataFrame:
    """key and, for each name, the only value of the key, by one aggregation."""
    pairs = rows.select(key.alias("key"), *[text(v).alias(n) for n, v in values.items()]).where("key IS NOT NULL AND key != ''")
    ends = pairs.groupBy("key").agg(*[x for n in values for x in (F.min(n).alias(f"{n}_least"), F.max(n).alias(f"{n}_most"))])
    return ends.select("key", *[F.when(F.col(f"{n}_least") == F.col(f"{n}_most"), F.col(f"{n}_least")).alias(n) for n in values])


def classified(mapped: DataFrame) -> DataFrame:
    """How many keys a map settles, and how many it leaves ambiguous."""
    return mapped.agg(F.count_if(F.col("candidates") == 1).alias("unique_keys"), F.count_if(F.col("candidates") > 1).alias("ambiguous_keys"))


def on_board(repairs: DataFrame, orders: DataFrame, yes: bool) -> DataFrame:
    """Repairs whose order is (or isn't) on the order board, by zero-stripped numbers; repairs without one are never on it."""
    known = orders.select(norm_order("AUFNR").alias("board_order")).where("board_order != ''").distinct()
    return repairs.join(known, norm_order("AUFNR") == F.col("board_order"), "left_semi" if yes else "left_anti")


def admitted(stations: DataFrame, orders: DataFrame) -> DataFrame:
    """Station passes of known orders; here numbers must be equal as they are written."""
    known = orders.select(F.trim("AUFNR").alias("board_order")).where("board_order != ''").distinct()
    return stations.join(known, F.trim("AUFNR") == F.col("board_order"), "left_semi")


def fill_stations(stations: DataFrame, orders: DataFrame) -> DataFrame:
    """Each station pass with ``action``: keep, fill_sales, fill_production, delete (its sales order is unknown), ambiguous or unresolved."""
    production = F.when(~blank("AUFNR"), norm_order("AUFNR"))
    to_sales = unique_map(orders, norm_order("AUFNR"), F.col("VBELN")).select(F.col("key").alias("by_production"), F.col("value").alias("sales_found"), F.col("candidates").alias("sales_candidates"))
    to_production = unique_map(orders, norm_order("VBELN"), F.col("AUFNR")).select(F.col("key").alias("by_sales"), F.col("value").alias("production_found"), F.col("candidates").alias("production_candidates"))
    joined = stations.join(to_sales, spread_key(production, "HISTROYID") == F.col("by_production"), "left").join(to_production, spread_key(norm_order("KDAUF"), "HISTROYID") == F.col("by_sales"), "left")
    action = (
        F.when(~blank("KDAUF") & F.col("by_sales").isNull(), "delete")
        .when(blank("KDAUF") & F.col("sales_found").isNotNull(), "fill_sales")
        .when(blank("KDAUF") & (F.col("sales_candidates") > 1), "ambiguous")
        .when(~blank("KDAUF") & blank("AUFNR") & F.col("production_found").isNotNull(), "fill_production")
        .when(~blank("KDAUF") & blank("AUFNR") & (F.col("production_candidates") > 1), "ambiguous")
        .when(blank("KDAUF") | blank("AUFNR"), "unresolved")
        .otherwise("keep")
    )
    return joined.select(
        "HISTROYID", action.alias("action"),
        F.when(action == "fill_production", F.col("production_found")).otherwise(F.col("AUFNR")).alias("AUFNR"),
        F.when(action == "fill_sales", F.col("sales_found")).otherwise(F.col("KDAUF")).alias("KDAUF"),
    )


def planned_start(postings: DataFrame, orders: DataFrame) -> DataFrame:
    """Each posting with the planned start of its production order, else of its sales order, and how it was found.

    The second is tried where the first is absent or ambiguous.
    """
    first = unique_map(orders, norm_order("AUFNR"), F.col("gstrs_date")).select(F.col("key").alias("k1"), F.col("value").alias("v1"), F.col("candidates").alias("n1"))
    second = unique_map(orders, norm_order("VBELN"), F.col("gstrs_date")).select(F.col("key").alias("k2"), F.col("value").alias("v2"), F.col("candidates").alias("n2"))
    joined = postings.join(first, spread_key(norm_order("AUFNR_1"), "posting_id") == F.col("k1"), "left").join(second, spread_key(norm_order("VBELN_EX"), "posting_id") == F.col("k2"), "left")
    found = F.when(F.col("v1").isNotNull(), "production").when(F.col("v2").isNotNull(), "sales").when((F.col("n1") > 1) | (F.col("n2") > 1), "ambiguous").otherwise("unmatched")
    return joined.select("posting_id", F.coalesce("v1", "v2").alias("planned_start"), found.alias("found"))


def pairs_map(rows: DataFrame, key: str, production: str, sales: str) -> DataFrame:
    """key -> the only (production order, sales order) of rows that have all three."""
    full = rows.where(~blank(key) & ~blank(production) & ~blank(sales))
    pair = F.struct(F.trim(production).alias("production"), F.trim(sales).alias("sales"))
    counted = full.groupBy(F.trim(key).alias("key")).agg(F.count_distinct(pair).alias("candidates"), F.min(pair).alias("pair"))
    return counted.where("candidates = 1").select("key", "pair.production", "pair.sales")


def backfill_repairs(repairs: DataFrame, stations: DataFrame, orders: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Repairs with orders filled step by step, each step only where the earlier ones left a blank.

    From station passes by serial number; from other repairs by serial number; production order from ``external`` (PCODE, AUFNR);
    sales order and planned start from the order board. A value that is there is never overwritten, and a pair is used only
    if it agrees with the production order that is there.
    """
    rows = repairs.select("repair_id", "PCODE", F.coalesce(F.trim("AUFNR"), F.lit("")).alias("AUFNR"), F.coalesce(F.trim("VBELN"), F.lit("")).alias("VBELN"), F.coalesce("GSTRS", F.lit("")).alias("GSTRS"))
    a = pairs_map(stations, "PCODE", "AUFNR", "KDAUF").select(F.col("key").alias("ka"), F.col("production").alias("pa"), F.col("sales").alias("sa"))
    b = pairs_map(repairs, "PCODE", "AUFNR", "VBELN").select(F.col("key").alias("kb"), F.col("production").alias("pb"), F.col("sales").alias("sb"))
    rows = rows.join(a, F.col("PCODE") == F.col("ka"), "left").join(b, F.col("PCODE") == F.col("kb"), "left")
    incomplete = (F.col("AUFNR") == "") | (F.col("VBELN") == "")
    agrees = lambda p: F.col(p).isNotNull() & incomplete & ((F.col("AUFNR") == "") | (norm_order("AUFNR") == norm_order(p)))
    step = F.when(agrees("pa"), "stations").when(agrees("pb"), "repairs")
    production = F.when(F.col("AUFNR") != "", F.col("AUFNR")).when(step == "stations", F.col("pa")).when(step == "repairs", F.col("pb")).otherwise("")
    sales = F.when(F.col("VBELN") != "", F.col("VBELN")).when(step == "stations", F.col("sa")).when(step == "repairs", F.col("sb")).otherwise("")
    rows = rows.select("repair_id", "PCODE", production.alias("AUFNR"), sales.alias("VBELN"), "GSTRS", F.coalesce(step, F.lit("")).alias("step"))
    if external is not None:
        more = unique_map(external, F.trim("PCODE"), F.col("AUFNR")).select(F.col("key").alias("ke"), F.col("value").alias("ve"))
        rows = rows.join(more, F.col("PCODE") == F.col("ke"), "left").withColumn("AUFNR", F.when(F.col("AUFNR") == "", F.coalesce("ve", F.lit(""))).otherwise(F.col("AUFNR"))).drop("ke", "ve")
    board = unique_maps(orders, norm_order("AUFNR"), {"v1": F.col("VBELN"), "v2": F.col("gstrs_date")})
    rows = rows.join(board, spread_key(norm_order("AUFNR"), "repair_id") == F.col("key"), "left")
    return rows.select(
        "repair_id", "AUFNR", F.when(F.col("VBELN") == "", F.coalesce("v1", F.lit(""))).otherwise(F.col("VBELN")).alias("VBELN"),
        F.when(F.col("GSTRS") == "", F.coalesce("v2", F.lit(""))).otherwise(F.col("GSTRS")).alias("GSTRS"), "step",
    )


def backfill_chain(repairs: DataFrame, stations: DataFrame, orders: DataFrame, external: dict[str, DataFrame] | None = None) -> DataFrame:
    """Repairs with orders filled step by step, and where each value comes from.

    A blank order or sales order is filled by the serial number's only pair in ``stations``, else by its only pair among the repairs themselves, never against a production
    order that is there (``conflict`` tells those that stations disagree with). A production order that is still blank comes from the first of the ``external`` sources (PCODE, AUFNR)
    that has just one; then sales order and planned start from the order board. One source that can't be read fails the whole run, so nothing is written by halves.
    """
    trimmed = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    rows = repairs.select("repair_id", "PCODE", trimmed("AUFNR"), trimmed("VBELN"), trimmed("GSTRS")).withColumn("serial", spread_key(F.col("PCODE"), "repair_id"))
    a = pairs_map(stations, "PCODE", "AUFNR", "KDAUF").select(F.col("key").alias("serial"), F.col("production").alias("pa"), F.col("sales").alias("sa"))
    b = pairs_map(repairs, "PCODE", "AUFNR", "VBELN").select(F.col("key").alias("serial"), F.col("production").alias("pb"), F.col("sales").alias("sb"))
    rows = rows.join(a, "serial", "left").join(b, "serial", "left")
    same = lambda p: norm_order("AUFNR") == norm_order(p)
    open_ = (F.col("AUFNR") == "") | (F.col("VBELN") == "")
    fits = lambda p: F.coalesce(open_ & ((F.col("AUFNR") == "") | same(p)), F.lit(False))
    step = F.when(fits("pa") & F.col("pa").isNotNull(), "stations").when(fits("pb") & F.col("pb").isNotNull(), "repairs").otherwise("")
    conflict = F.coalesce(F.col("pa").isNotNull() & (F.col("AUFNR") != "") & ~same("pa"), F.lit(False))
    rows = rows.withColumns({"step": step, "conflict": conflict})
    pair = lambda kept, one, other: F.when(F.col(kept) != "", F.col(kept)).when(F.col("step") == "stations", F.col(one)).when(F.col("step") == "repairs", F.col(other)).otherwise("")
    from_pair = lambda c: F.when((F.col(c) == "") & (F.col("step") != ""), F.col("step")).otherwise("")
    rows = rows.select("repair_id", "serial", "GSTRS", "conflict", from_pair("AUFNR").alias("order_source"), from_pair("VBELN").alias("sales_source"), pair("AUFNR", "pa", "pb").alias("AUFNR"), pair("VBELN", "sa", "sb").alias("VBELN"))
    for name, source in (external or {}).items():
        only = unique_map(source, F.trim("PCODE"), F.col("AUFNR")).where("value IS NOT NULL").select(F.col("key").alias("serial"), "value")
        found = (F.col("AUFNR") == "") & F.col("value").isNotNull()
        rows = rows.join(only, "serial", "left").withColumns({"order_source": F.when(found, F.lit(name)).otherwise(F.col("order_source")), "AUFNR": F.when(found, F.col("value")).otherwise(F.col("AUFNR"))}).drop("value")
    board = unique_maps(orders, norm_order("AUFNR"), {"board_sales": F.col("VBELN"), "board_start": F.col("gstrs_date")})
    rows = rows.join(board, spread_key(norm_order("AUFNR"), "repair_id") == F.col("key"), "left")
    lacks = lambda c, of: (F.col(c) == "") & F.col(of).isNotNull()
    return rows.select(
        "repair_id", "AUFNR", F.when(lacks("VBELN", "board_sales"), F.col("board_sales")).otherwise(F.col("VBELN")).alias("VBELN"), F.when(lacks("GSTRS", "board_start"), F.col("board_start")).otherwise(F.col("GSTRS")).alias("GSTRS"),
        "order_source", F.when(lacks("VBELN", "board_sales"), "board").otherwise(F.col("sales_source")).alias("sales_source"), F.when(lacks("GSTRS", "board_start"), "board").otherwise("").alias("start_source"), "conflict",
    )


def backfill_counts(filled: DataFrame) -> DataFrame:
    """(field, source, n): how many values each source filled, and how many repairs stations disagree with."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_source").alias("source")) for f in ("order", "sales", "start")], F.struct(F.lit("conflict").alias("field"), F.when(F.col("conflict"), "stations").otherwise("").alias("source")))
    return filled.select(F.explode(fields).alias("f")).select("f.*").where("source != ''").groupBy("field", "source").agg(F.count("*").alias("n"))


def change_flags(changes: DataFrame, declarations: DataFrame) -> DataFrame:
    """Changes with ``is_company``: whether a declaration of the company has the change's service order among its aliases."""
    own = declarations.where(company_flag(F.lit(None).cast("string"), F.col("service_uid")))
    aliases = own.select(F.explode(F.array_distinct(F.array(F.upper(F.trim("service_uid")), F.upper(F.trim("doa_code"))))).alias("alias")).where("alias != ''").distinct()
    return changes.join(aliases, F.upper(F.trim("so_code")) == F.col("alias"), "left").select("change_id", F.col("alias").isNotNull().alias("is_company"))


def flag_changes(declarations: DataFrame, old: str) -> DataFrame:
    """How many rows a recomputed company flag would change."""
    new = company_flag(F.lit(None).cast("string"), F.col("service_uid"))
    return declarations.agg(F.count("*").alias("total"), F.count_if(new).alias("company"), F.count_if(~F.col(old).eqNullSafe(new)).alias("would_update"))
