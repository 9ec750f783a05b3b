"""Snapshots against stored rows of which several can have one identity: one of them stays, the others go, references follow.

Stored rows have ``id``, the ``identity`` worked out from their values, the ``identity`` that they were stored under (null for old ones), when they
were synced, a digest of their values, whether the snapshot's window covers them, and the ids they were known by before. Of the rows of one identity the canonical one is the greatest by (stored under
that identity, synced, id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(stored: DataFrame) -> DataFrame:
    """(identity, id, stored_identity, digest, aliases, superseded): the canonical row of each identity, every id that any of its rows had, and the ids of the other rows."""
    own = F.coalesce(F.col("stored_identity") == F.col("identity"), F.lit(False))
    best = F.max_by(F.struct("id", "stored_identity", "digest"), F.struct(own, F.coalesce("synced", F.lit("")), "id"))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))))))
    ids = F.collect_list("id")
    grouped = stored.where("identity IS NOT NULL").groupBy("identity").agg(best.alias("best"), names.alias("aliases"), ids.alias("ids"))
    return grouped.select("identity", "best.id", "best.stored_identity", "best.digest", "aliases", F.array_sort(F.array_except("ids", F.array("best.id"))).alias("superseded"))


def reconciled(snapshot: DataFrame, stored: DataFrame) -> DataFrame:
    """(identity, id, action, relinked, aliases, covered) of each row that is stored or in the snapshot (identity, digest); ids of new rows are null.

    insert, update or unchanged: a snapshot row and its canonical row; relinked: that was stored under another identity.
    superseded: another row of an identity in the snapshot, its id is an alias of the canonical one. stale: covered by the window, identity not in the snapshot; outside: not covered.
    A stored row without an identity is stale or outside.
    """
    best = canonical(stored)
    new = snapshot.select("identity", F.col("digest").alias("new_digest"), F.lit(True).alias("seen"))
    joined = best.join(new, "identity", "full_outer")
    action = F.when(F.col("id").isNull(), "insert").when(~F.col("digest").eqNullSafe(F.col("new_digest")), "update").otherwise("unchanged")
    relinked = F.col("id").isNotNull() & ~F.col("stored_identity").eqNullSafe(F.col("identity"))
    met = joined.where("seen").select("identity", "id", action.alias("action"), relinked.alias("relinked"), "aliases", F.lit(True).alias("covered"))
    others = joined.where("seen AND size(superseded) > 0").select("identity", F.explode("superseded").alias("id"), F.lit("superseded").alias("action"), F.lit(False).alias("relinked"), F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("covered"))
    inside = F.coalesce("covered", F.lit(False))
    left = stored.join(new.select("identity"), "identity", "left_anti").select("identity", "id", F.when(inside, "stale").otherwise("outside").alias("action"), F.lit(False).alias("relinked"), "aliases", inside.alias("covered"))
    return met.unionByName(others).unionByName(left)


def run_counts(plan: DataFrame) -> DataFrame:
    """One row: how many rows a plan inserts, updates, leaves, relinks and deletes, and how many stay in the window."""
    n = lambda *actions: F.count_if(F.col("action").isin(*actions))
    return plan.agg(
        n("insert").alias("inserted"), n("update").alias("updated"), n("unchanged").alias("unchanged"), F.count_if("relinked").alias("relinked"),
        n("superseded", "stale").alias("deleted"), n("insert", "update", "unchanged").alias("covered"), n("outside").alias("outside"),
    )


def deletable(written: DataFrame, snapshot: DataFrame, plan: DataFrame, override: bool = False) -> DataFrame:
    """The ids to delete after a run has written its rows; ``written`` has the identities that it wrote.

    An error unless as many different identities are written as the snapshot has, all of them its own; and, as before any delete, if the snapshot is empty or more
    than 100 rows and more than half of what is stored would go.
    """
    sides = snapshot.select("identity", F.lit(1).alias("in_snapshot"), F.lit(0).alias("in_store")).unionByName(written.select("identity", F.lit(0).alias("in_snapshot"), F.lit(1).alias("in_store")))
    seen = sides.groupBy("identity").agg(F.max("in_snapshot").alias("in_snapshot"), F.max("in_store").alias("in_store"))
    uneven = seen.agg(F.count_if(F.col("in_snapshot") + F.col("in_store") < 2).alias("n"), F.count_if(F.col("in_snapshot") == 1).alias("rows")).first()
    if uneven["n"]:
        raise ValueError(f"the snapshot isn't written whole: {uneven['n']} of its rows differ")
    counts = plan.agg(F.count_if(F.col("action").isin("stale", "superseded")).alias("gone"), F.count_if(F.col("covered") & (F.col("action") != "insert")).alias("stored")).first()
    if counts["gone"] and not override and (uneven["rows"] == 0 or (counts["gone"] > 100 and 2 * counts["gone"] > counts["stored"])):
        raise ValueError(f"{counts['gone']} of {counts['stored']} stored rows would go")
    return plan.where("action IN ('stale', 'superseded')").select("id")


def relinked_references(references: DataFrame, plan: DataFrame, column: str) -> DataFrame:
    """References to a row by any id that it ever had, moved to its canonical id; others stay as they are."""
    moved = plan.where("id IS NOT NULL AND action IN ('update', 'unchanged')").select(F.explode("aliases").alias(column), F.col("id").alias("_now")).where(f"{column} != _now")
    return references.join(moved, column, "left").withColumn(column, F.coalesce("_now", column)).drop("_now")
