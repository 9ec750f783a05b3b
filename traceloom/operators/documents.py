"""Order documents with nested fields and aliases, ids of views, values at nested paths, and how repairs match the orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.scalars import first_text, first_value, optional_flag, optional_number, parse_time, text

#: The aliases of an order's shipment, in the order in which they count.
SHIPPED = ("shipmentDate", "shipment_date", "actualShipmentDate", "actual_shipment_date", "WADAT_IST", "SHIPMENT_DATE")
SHIPPED_QUANTITY = ("shipmentQuantity", "shipment_quantity", "actualShipmentQuantity", "actual_shipment_quantity", "LFIMG", "SHIPMENT_QUANTITY")
COMPANY = ("is5000Company", "is_5000_company", "company5000", "IS_5000_COMPANY")


def aliases(rows: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """The columns that hold a value: those inside ``data`` first, then those beside it; names that the dataset lacks are left out."""
    inner = rows.schema["data"].dataType.names
    return [F.col(f"data.{n}") for n in names if n in inner] + [F.col(n) for n in names if n in rows.columns]


def normal_order(rows: DataFrame) -> DataFrame:
    """Orders under their public names. The first alias that isn't null counts, even if it can't be parsed; then the value is null."""
    inner = lambda c: first_text(f"data.{c}")
    value = lambda names: first_value(*found) if (found := aliases(rows, names)) else F.lit(None).cast("string")
    return rows.select(
        "order_id", "source", inner("VBELN").alias("sales_order"), inner("KID").alias("customer"), inner("MAKTX_TH").alias("model"), inner("LGORT").alias("location"), inner("GSTRS").alias("planned_start"),
        text(value(SHIPPED)).alias("shipped_on"), optional_number(value(SHIPPED_QUANTITY)).alias("shipped_quantity"), optional_flag(value(COMPANY)).alias("is_5000_company"),
    )


def view_ids(rows: DataFrame, keys: list[str], station: list[str]) -> DataFrame:
    """Rows with ``id``, the first key that isn't blank, and ``station_code``, which is derived only where it is absent."""
    given = [F.col("station_code").cast("string")] if "station_code" in rows.columns else []
    return rows.withColumns({"id": first_text(*keys), "station_code": F.coalesce(*given, first_text(*station))})


def repair_time(rows: DataFrame) -> Column:
    """When a repair was done: its time, else day and clock of the repair, else of the reading, else either day, else the load."""
    there = lambda *names: all(n in rows.columns for n in names)
    found = [parse_time("ZWXDT")] if there("ZWXDT") else []
    for day in ("ZDATE_WX", "ZDATE"):
        if there(day, "ZTIME"):
            found.append(F.try_to_timestamp(F.concat(text(day), text("ZTIME")), F.lit("yyyyMMddHHmmss")))
    found += [parse_time(day) for day in ("ZDATE_WX", "ZDATE") if there(day)] + ([F.col("synced_at").cast("timestamp")] if there("synced_at") else [])
    return F.coalesce(*found)


def values_at(rows: DataFrame, path: str) -> DataFrame:
    """The different texts at a nested path, trimmed and without blanks."""
    return rows.select(text(F.col(path)).alias("value")).where("value IS NOT NULL").distinct()


def sales_order_match(repairs: DataFrame, orders: DataFrame) -> DataFrame:
    """How many repairs have a sales order that the orders have, one that they lack, or none; all of them stay."""
    known = orders.select(text("VBELN").alias("known")).where("known IS NOT NULL").distinct()
    own = text("VBELN")
    joined = repairs.join(known, own == F.col("known"), "left")
    return joined.agg(F.count_if(F.col("known").isNotNull()).alias("matched"), F.count_if(own.isNotNull() & F.col("known").isNull()).alias("unmatched"), F.count_if(own.isNull()).alias("empty"))


def option_lists(rows: DataFrame, columns: list[str], cap: int | None = None) -> DataFrame:
    """(name, value): the different values of several columns, trimmed and without blanks, by one pass; more than ``cap`` of one, if it is given, are an error."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), text(c).alias("value")) for c in columns]))
    found = rows.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").distinct()
    if cap is not None and not found.groupBy("name").count().where(F.col("count") > cap).isEmpty():
        raise ValueError(f"more than {cap} values of one of {columns}")
    return found


def bounded_count(rows: DataFrame, most: int) -> DataFrame:
    """The number of rows, counted up to ``most`` + 1."""
    return rows.limit(most + 1).agg(F.count("*").alias("counted")).withColumn("over", F.col("counted") > most)


def samples(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` examples for a report, in a full order."""
    return rows.orderBy(*order).limit(n)


def matching_devices(declarations: DataFrame, company: Column | None = None, sales_order: str = "", service_order: str = "", serial: str = "") -> DataFrame:
    """Declarations by company, by sales order of the document or of its equipment, by service order, and by any serial number of its equipment."""
    in_equipment = lambda names, value: F.exists("equipment", lambda e: F.coalesce(e[names[0]] == value, F.lit(False)) | (F.coalesce(e[names[-1]] == value, F.lit(False))))
    found = declarations if company is None else declarations.where(company)
    if value := sales_order.strip():
        found = found.where((F.col("sales_order") == value) | in_equipment(["production_order"], value))
    if value := service_order.strip():
        found = found.where(F.col("service_uid") == value)
    if value := serial.strip():
        found = found.where(in_equipment(["product", "material_sn"], value))
    return found
