"""Roll-ups: order documents from lines, devices from equipment, values from evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.scalars import norm_order, number, parse_date, text


def order_documents(lines: DataFrame) -> DataFrame:
    """One row an order: the last line's fields, the number of lines, quantities, and whether a line's model is for overseas.

    Lines without an order number are left out. The lines themselves can be had by ``with_records``.
    """
    kept = lines.where(text("AUFNR").isNotNull())
    last = lambda c: F.max_by(c, "position")
    return kept.groupBy("source", "AUFNR").agg(
        F.count("*").alias("record_count"), F.sum(number("GAMNG")).alias("order_quantity"), F.sum(number("WMENG")).alias("storage_quantity"),
        last("MAKTX").alias("MAKTX"), last("ZSTAT").alias("ZSTAT"), F.date_format(parse_date(last("GSTRS")), "yyyy-MM-dd").alias("gstrs_date"),
        F.bool_or(F.lower("MAKTX").contains("ww")).alias("is_overseas"),
    )


def with_records(lines: DataFrame) -> DataFrame:
    """One row an order with its lines as an array, in their order; an order's lines are few."""
    record = F.struct("position", "GAMNG", "WMENG", "MAKTX", "ZSTAT", "GSTRS")
    return lines.where(text("AUFNR").isNotNull()).groupBy("source", "AUFNR").agg(F.sort_array(F.collect_list(record)).alias("records"))


def document_quantity(stored: Column, lines: Column, single: Column) -> Column:
    """The stored quantity, else the sum over the lines, else the single field."""
    return F.coalesce(stored, F.when(F.size(lines) > 0, F.aggregate(lines, F.lit(0.0), lambda s, x: s + number(x))), number(single))


def evidence(declarations: DataFrame) -> DataFrame:
    """One row a piece of equipment, with the device it belongs to: by product, else context, else material, else by place."""
    parts = declarations.select("doa_code", "sales_order", "declare_time", F.posexplode_outer("equipment").alias("place", "e"))
    device = F.coalesce(
        F.concat(F.lit("product:"), text("e.product")), F.concat(F.lit("context:"), text("e.context_value")), F.concat(F.lit("material:"), text("e.material_sn")),
        F.concat(F.lit("unidentified:"), "doa_code", F.lit(":"), F.coalesce(F.col("place"), F.lit(0)).cast("string")),
    )
    return parts.select(device.alias("device"), "doa_code", "sales_order", "place", text("e.material_sn").alias("material_sn"), text("e.factory_date").alias("factory_date"), text("e.production_order").alias("production_order"))


def resolved_dates(dates: Column) -> Column:
    """missing, invalid, conflict or valid, for an array of date texts; one bad text among good ones counts as invalid."""
    texts = F.array_distinct(F.filter(dates, lambda d: d.isNotNull() & (d != "")))
    days = F.array_distinct(F.filter(F.transform(texts, parse_date), lambda d: d.isNotNull()))
    bad = F.exists(texts, lambda t: parse_date(t).isNull())
    return F.when(F.size(days) > 1, "conflict").when(bad, "invalid").when(F.size(days) == 0, "missing").otherwise("valid")


def devices(found: DataFrame, matching: Column | None = None) -> DataFrame:
    """One row a device with its evidence summed up; with ``matching``, devices that have at least one such piece."""
    grouped = found.groupBy("device").agg(
        F.count("*").alias("pieces"), F.count_distinct("doa_code").alias("documents"), F.count_distinct("material_sn").alias("materials"),
        F.min("sales_order").alias("first_sales_order"), F.collect_set("factory_date").alias("dates"), F.bool_or(F.lit(True) if matching is None else matching).alias("hit"),
    )
    return grouped.where("hit").select("device", "pieces", "documents", "materials", "first_sales_order", resolved_dates(F.col("dates")).alias("factory_status"))


def expanded(found: DataFrame, matching: Column) -> DataFrame:
    """All evidence of the devices that a matching document touches: one hop from documents to devices and back."""
    touched = found.where(matching).select("device").distinct()
    return found.join(touched, "device", "left_semi")


def company_orders(found: DataFrame, orders: DataFrame) -> DataFrame:
    """Evidence with whether its production order is on the board."""
    known = orders.select(norm_order("AUFNR").alias("board")).distinct()
    return found.join(known, norm_order("production_order") == F.col("board"), "left").withColumn("known", F.col("board").isNotNull()).drop("board")
