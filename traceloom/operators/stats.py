"""Statistics: one aggregation a dataset, and facets over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.scalars import blank, missing, norm_order


def different(c: Column) -> Column:
    """Different values but for null and the empty text."""
    return F.count_distinct(F.nullif(c, F.lit("")))


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def repair_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"),
        count_if(~missing("ERROR_CODE") | ~missing("ERROR_MSG")).alias("with_error"),
        count_if(~missing("U_FIX")).alias("with_person"),
        count_if(~missing("MATNR")).alias("with_material"),
        count_if(~missing("RECORD01REPAIRM")).alias("with_part_serial"),
        count_if(missing("VBELN")).alias("missing_sales"),
        count_if(missing("AUFNR")).alias("missing_production"),
        different(norm_order("VBELN")).alias("sales_orders"),
        different(norm_order("AUFNR")).alias("production_orders"),
        different(F.col("PCODE")).alias("hosts"),
        F.min("ZDATE_WX").alias("first_day"),
        F.max("ZDATE_WX").alias("last_day"),
    )


def order_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"),
        different(norm_order("VBELN")).alias("sales_orders"),
        count_if(F.col("source") == "SG").alias("sg"),
        count_if(F.col("source") == "KK").alias("kk"),
        F.coalesce(F.sum("order_quantity"), F.lit(0.0)).alias("order_quantity"),
        F.coalesce(F.sum("storage_quantity"), F.lit(0.0)).alias("storage_quantity"),
        F.date_format(F.min("gstrs_date"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("gstrs_date"), "yyyy-MM-dd").alias("last_day"),
    )


def view_stats(rows: DataFrame, date: str | None) -> DataFrame:
    """Rows, and first and last day where the view has a date."""
    days = [F.date_format(F.min(date), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(date), "yyyy-MM-dd").alias("last_day")] if date else []
    return rows.agg(F.count("*").alias("total"), *days)


def station_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), count_if(blank("KDAUF")).alias("missing_sales"), count_if(blank("AUFNR")).alias("missing_production"), F.date_format(F.max("gstrs_date"), "yyyy-MM-dd").alias("last_day"))


def posting_stats(rows: DataFrame) -> DataFrame:
    lost = F.coalesce(F.nullif(F.col("VBELN_EX"), F.lit("")), F.col("posting_id"))
    return rows.agg(
        F.count("*").alias("total"),
        different(norm_order("VBELN_EX")).alias("sales_orders"),
        different(norm_order("AUFNR_1")).alias("production_orders"),
        count_if(blank("VBELN_EX")).alias("missing_sales"),
        count_if(blank("AUFNR_1")).alias("missing_production"),
        F.count_distinct(F.when(missing("AUFNR_1"), lost)).alias("missing_production_different"),
    )


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of several columns, by grouping sets over one scan."""
    sets = [[F.col(c)] for c in columns]
    which = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    return rows.groupingSets(sets, *columns).agg(which.alias("facet"), value.alias("value"), F.count("*").alias("n")).select("facet", "value", "n")


def transitions(rows: DataFrame, before: str, after: str) -> DataFrame:
    return rows.where(~F.col(before).eqNullSafe(F.col(after))).groupBy(F.concat_ws(" -> ", before, after).alias("change")).agg(F.count("*").alias("n"))


def retention(rows: DataFrame, column: str, kept: str) -> DataFrame:
    """How many rows a retention rule keeps: those of one value (trimmed); the empty and other ones go."""
    value = F.trim(F.coalesce(F.col(column), F.lit("")))
    return rows.agg(count_if(value == kept).alias("kept"), count_if(value == "").alias("empty"), count_if((value != "") & (value != kept)).alias("other"))
