"""Diagnostics of finished jobs: skew, spill and repeated work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.sketches import running_total


def skew(tasks: DataFrame, records: str, share: float = 0.9) -> DataFrame:
    """``tasks, busy, busy_share``: the fewest tasks that hold ``share`` of all
    records. A small share of busy tasks shows a skewed partitioning."""
    ordered = tasks.select(F.col(records).alias("__n"), F.struct((-F.col(records)).alias("n"), "task").alias("__order"))
    rows = running_total(ordered, "__order", "__n")
    whole = tasks.agg(F.coalesce(F.sum(records), F.lit(0)).alias("__all"))
    busy = F.count_if(F.col("running") - F.col("__n") < F.col("__all") * share)
    return rows.crossJoin(F.broadcast(whole)).agg(F.count("*").alias("tasks"), busy.alias("busy")).withColumn("busy_share", F.col("busy") / F.col("tasks"))  # one row


def spill_ratio(tasks: DataFrame, spilled: str, output: str) -> DataFrame:
    """Spilled records for each output record; one is the least."""
    return tasks.agg((F.sum(spilled) / F.sum(output)).alias("spill_ratio"))


def reexecution_ratio(tasks: DataFrame, launched: str, finished: str) -> DataFrame:
    """Share of launched attempts that were not needed."""
    return tasks.agg(((F.sum(launched) - F.sum(finished)) / F.sum(launched)).alias("reexecuted"))
