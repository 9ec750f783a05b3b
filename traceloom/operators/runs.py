"""Queries of the run log, and reports of what a run found. Each run has its stages as an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_runs(runs: DataFrame, number: int) -> DataFrame:
    return runs.orderBy(F.desc("started"), F.desc("run_id")).limit(number)


def latest_stage(runs: DataFrame, task: str, state: str | None = None) -> DataFrame:
    """The newest run that has a stage of the task (in a state), with that stage alone."""
    wanted = lambda s: (s["task"] == task) & (F.lit(True) if state is None else s["state"] == state)
    return last_runs(runs.where(F.exists("stages", wanted)), 1).select("run_id", "started", F.filter("stages", wanted)[0].alias("stage")).select("run_id", "started", "stage.task", "stage.state")


def last_success(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each task of the catalogue with the start of its newest successful stage; null if there's none."""
    done = runs.select("started", F.explode("stages").alias("s")).where("s.state = 'success'").groupBy(F.col("s.task").alias("task")).agg(F.max("started").alias("last_success"))
    return tasks.join(done, "task", "left")


def abandoned(runs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Running runs whose last sign is older than ``minutes``."""
    return runs.where((F.col("state") == "running") & (F.col("heartbeat") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES")))


def comparison_report(differences: DataFrame) -> DataFrame:
    """One row: counts by kind, and success, or warning if anything differs."""
    counts = differences.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "extra", "field_mismatch")])
    return counts.withColumn("state", F.when(F.col("missing") + F.col("extra") + F.col("field_mismatch") == 0, "success").otherwise("warning"))


def stale_in_scope(stored: DataFrame, snapshot: DataFrame, keys: list[str], scope: Column) -> DataFrame:
    """Stored rows in scope whose key the full snapshot doesn't have."""
    return stored.where(scope).join(snapshot.select(*keys).distinct(), keys, "left_anti")


def require_in_window(rows: DataFrame, day: Column, first: str, last: str) -> DataFrame:
    """The rows, with ``day`` checked: a row without a day, or with one out of the window, fails the run when it is read."""
    good = F.coalesce((day >= F.lit(first).cast("date")) & (day <= F.lit(last).cast("date")), F.lit(False))
    message = F.concat(F.lit("a row is out of the window: "), F.coalesce(day.cast("string"), F.lit("no date")))
    return rows.withColumn("_day", F.when(good, day).otherwise(F.raise_error(message).cast("date"))).where(F.col("_day").isNotNull()).drop("_day")
