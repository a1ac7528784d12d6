"""Background tasks: what their log of runs says of them now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.state import backoff


def islands(runs: DataFrame) -> DataFrame:
    """(task, island, ok, first_at, last_at, runs) of runs (task, at, run_id, ok): stretches of runs of one outcome, in order."""
    by = Window.partitionBy("task").orderBy("at", "run_id")
    edge = F.when(F.lag("ok").over(by).eqNullSafe(F.col("ok")), 0).otherwise(1)
    rows = runs.withColumn("edge", edge).withColumn("island", F.sum("edge").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("task", "island").agg(F.first("ok").alias("ok"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("runs"))


def states(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task, last_run_at, last_status, last_summary, failures, next_run_at) of tasks (task, interval_s) by their runs (task, at,
    run_id, ok, summary): failures are those since the last success, counted without a window over all runs; the next run is an interval
    after the last one, longer after failures, and at once (null) where there was none."""
    order = F.struct("at", "run_id")
    good = runs.where("ok").groupBy("task").agg(F.max(order).alias("good"))
    rows = runs.join(good, "task", "left")
    after = ~F.col("ok") & (F.col("good").isNull() | (order > F.col("good")))
    now = rows.groupBy("task").agg(F.max("at").alias("last_run_at"), F.max_by(F.struct("ok", "summary"), order).alias("last"), F.count_if(after).alias("failures"))
    out = tasks.join(now, "task", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    wait: Column = backoff(F.col("failures"), F.col("interval_s"))
    return out.select("task", "last_run_at", F.when(F.col("last.ok"), "ok").when(~F.col("last.ok"), "error").alias("last_status"), F.col("last.summary").alias("last_summary"), "failures", (F.col("last_run_at") + F.make_dt_interval(secs=wait)).alias("next_run_at"))


def due(tasks: DataFrame, now: Column) -> DataFrame:
    """States whose next run has come, the one that waits longest first."""
    return tasks.where(F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)).orderBy(F.col("next_run_at").asc_nulls_first(), "task")
