"""Snapshots against stored rows: conflicts, changes, differences, guards and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 256)


def conflicts(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with more than one different value, and how often keys repeat with the same one."""
    kinds = rows.groupBy(*keys).agg(F.count("*").alias("copies"), F.count_distinct(row_digest(values)).alias("kinds"))
    return kinds.where("copies > 1")


def require_no_conflict(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row a key; a key with different values is an error before anything is written."""
    found = conflicts(rows, keys, values).where("kinds > 1").select(*keys).limit(1).collect()
    if found:
        raise ValueError(f"different rows of one key: {found[0].asDict()}")
    return rows.dropDuplicates(keys)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key whose parts are all there, the first by ``order``; rows with an incomplete key all stay."""
    whole = reduce(lambda a, b: a & b, [F.trim(F.coalesce(F.col(k), F.lit(""))) != "" for k in keys])
    ranked = rows.where(whole).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth").unionByName(rows.where(~whole))


def classify(snapshot: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every key with ``action``: insert, update, unchanged or stale, by the digests of its values."""
    new = snapshot.select(*keys, row_digest(values).alias("new_digest"))
    old = stored.select(*keys, row_digest(values).alias("old_digest"))
    action = F.when(F.col("old_digest").isNull(), "insert").when(F.col("new_digest").isNull(), "stale").when(F.col("new_digest") == F.col("old_digest"), "unchanged").otherwise("update")
    return new.join(old, keys, "full_outer").select(*keys, action.alias("action"))


def guarded(actions: DataFrame, override: bool = False) -> DataFrame:
    """The stale keys to delete; an error if the source is empty, or more than 100 and more than half of what is stored would go."""
    seen = actions.agg(F.count_if(F.col("action") != "stale").alias("source"), F.count_if(F.col("action") == "stale").alias("stale"), F.count_if(F.col("action") != "insert").alias("stored")).first()
    if not override and seen["stale"] and (seen["source"] == 0 or (seen["stale"] > 100 and 2 * seen["stale"] > seen["stored"])):
        raise ValueError(f"{seen['stale']} of {seen['stored']} stored rows would go")
    return actions.where("action = 'stale'").drop("action")


def guard_report(actions: DataFrame) -> DataFrame:
    """The counts that the guard looks at, and what it decides."""
    seen = actions.agg(F.count_if(F.col("action") != "stale").alias("source_rows"), F.count_if(F.col("action") == "stale").alias("stale_rows"), F.count_if(F.col("action") != "insert").alias("stored_rows"))
    stop = (F.col("stale_rows") > 0) & ((F.col("source_rows") == 0) | ((F.col("stale_rows") > 100) & (2 * F.col("stale_rows") > F.col("stored_rows"))))
    return seen.withColumn("blocked", stop)


def upserted(stored: DataFrame, snapshot: DataFrame, keys: list[str], values: list[str], now: str) -> DataFrame:
    """The stored rows after an upsert: new values where there are any, times of first sight and change, and a count of changes."""
    old = stored.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.col("first_seen"), F.col("last_synced"), F.col("sync_count"), F.lit(True).alias("in_store"))
    new = snapshot.select(*keys, *values, F.lit(True).alias("in_source"))
    joined = old.join(new, keys, "full_outer")
    source, store = F.coalesce("in_source", F.lit(False)), F.coalesce("in_store", F.lit(False))
    changed = source & (~store | reduce(lambda a, b: a | b, [~F.col(v).eqNullSafe(F.col(f"old_{v}")) for v in values]))
    return joined.select(
        *keys, *[F.when(source, F.col(v)).otherwise(F.col(f"old_{v}")).alias(v) for v in values],
        F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.when(changed, F.lit(now)).otherwise(F.col("last_synced")).alias("last_synced"),
        (F.coalesce("sync_count", F.lit(0)) + changed.cast("int")).alias("sync_count"),
    )


def differences(source: DataFrame, target: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, kind, fields) of rows that differ: missing in the target, extra in it, or with fields that differ."""
    a = source.select(*[F.trim(k).alias(k) for k in keys], *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    b = target.select(*[F.trim(k).alias(k) for k in keys], *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    fields = F.concat_ws(",", *[F.when(~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")), F.lit(v)) for v in values])
    kind = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(fields != "", "field_mismatch")
    joined = a.join(b, keys, "full_outer")
    return joined.select(*keys, kind.alias("kind"), F.when(kind == "field_mismatch", fields).otherwise("").alias("fields")).where("kind IS NOT NULL")


def refreshed_status(stored: DataFrame, source: DataFrame, line: list[str], order: list[str], status: str = "ZSTAT", exempt: str = "RELEASED") -> DataFrame:
    """(order, outcome): an order is updated only if each of its lines has one status in the source; else it is left whole.

    Lines in the exempt status may be absent; an order none of whose lines the source returns is ``not_returned``.
    """
    one = source.groupBy(*line).agg(F.count_distinct(status).alias("kinds"), F.min(status).alias("new_status"))
    joined = stored.join(one, line, "left")
    met = F.col("new_status").isNotNull() & (F.col("kinds") == 1)
    grouped = joined.groupBy(*order).agg(F.bool_or(F.col("new_status").isNotNull()).alias("any_line"), F.bool_and(met | (F.col(status) == exempt)).alias("every_line"), F.bool_or(met & (F.col("new_status") != F.col(status))).alias("moved"))
    outcome = F.when(~F.col("any_line"), "not_returned").when(~F.col("every_line"), "blocked").when(F.col("moved"), "updated").otherwise("unchanged")
    return grouped.select(*order, outcome.alias("outcome"))


def enriched_kept(snapshot: DataFrame, stored: DataFrame, key: str, owner: str, fields: list[str]) -> DataFrame:
    """Snapshot rows with enriched fields taken over where the source has a blank; a changed ``owner`` voids them."""
    old = stored.select(key, F.col(owner).alias("old_owner"), *[F.col(f).alias(f"old_{f}") for f in fields])
    same = (F.coalesce(F.col(owner), F.lit("")) == "") | (F.col(owner) == F.col("old_owner"))
    blank = lambda f: F.coalesce(F.col(f), F.lit("")) == ""
    filled = [F.when(blank(f) & same, F.coalesce(f"old_{f}", F.lit(""))).otherwise(F.coalesce(f, F.lit(""))).alias(f) for f in fields]
    return snapshot.join(old, key, "left").select(key, *filled)
