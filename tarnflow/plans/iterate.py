"""Iterative jobs: loop-invariant static rows, and a state that each step replaces.

A step joins the static rows with the state by a projection of the static key,
maps each pair, and reduces by key into the new state. Static rows are dealt by
the projected key once and kept, so a step shuffles only the state and the mapped
values. The state is written to shared storage, which cuts its lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.storage import discard, materialize


class Projection(Enum):
    """How static keys depend on state keys."""

    ONE2ONE = "one static key, one state key"
    ONE2MUL = "many static keys share a state key"
    ONE2ALL = "every static key needs the whole state"


#: Rows of a state that goes to every task whole, at most.
MOST_STATE = 1_000_000


@dataclass
class Projector:
    """From static rows to the key ``dk`` of the state that they need."""

    project: Column | None = None
    kind: Projection = Projection.ONE2ONE

    def prepare(self, static: DataFrame) -> DataFrame:
        """Static rows dealt by the state key and kept for all steps."""
        if self.kind is Projection.ONE2ALL:
            return static.persist(StorageLevel.MEMORY_AND_DISK)
        n = int(static.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # by state key, and within it by static key
        return static.withColumn("dk", self.project).repartition(n, "dk").sortWithinPartitions("dk", "sk").persist(StorageLevel.MEMORY_AND_DISK)

    def pair(self, prepared: DataFrame, state: DataFrame) -> DataFrame:
        """Static rows with their state; under ONE2ALL the whole state, which is one
        list, goes to every task; it may have ``MOST_STATE`` rows at most."""
        if self.kind is Projection.ONE2ALL:
            rows = state.count()
            if rows > MOST_STATE:
                raise ValueError(f"a state of {rows} rows is too large for every task; use another projection")
            whole = state.agg(F.array_sort(F.collect_list(F.struct("dk", "dv"))).alias("state"))
            return prepared.crossJoin(F.broadcast(whole))  # one row
        return prepared.join(state, "dk")


def identity_projector() -> Projector:
    """The static key is the state key."""
    return Projector(F.col("sk"))


@dataclass
class Result:
    state: DataFrame
    iterations: int
    distance: float | None
    converged: bool


@dataclass
class IterativeJob:
    """``step`` turns (static, state) pairs and the old state into the new state
    ``dk, dv``; ``distance`` compares ``prev`` and ``curr`` of a key."""

    static: DataFrame
    state: DataFrame
    projector: Projector
    step: Callable[[DataFrame, DataFrame], DataFrame]
    distance: Column | None = None
    done: Callable[[int, DataFrame], None] | None = None

    def run(self, iterations: int, threshold: float | None = None, checkpoint_every: int = 1, still: float | None = None) -> Result:
        """At most ``iterations`` steps; with a threshold, until the summed distance
        is below it; with ``still``, until no key moved by more than that from one
        checkpoint to the next."""
        prepared = self.projector.prepare(self.static)
        state, distance, converged, turn = self.state, None, False, 0
        written = None
        try:
            for turn in range(1, iterations + 1):
                new = self.step(self.projector.pair(prepared, state), state)
                if turn % checkpoint_every == 0 or threshold is not None or turn == iterations:
                    new = materialize(new, "state")
                if threshold is not None:
                    distance = total_distance(state, new, self.distance)
                    converged = distance < threshold
                state = new
                if hasattr(new, "_written_to"):
                    if still is not None and written is not None:
                        converged = converged or largest_move(written, new) <= still
                    if written is not None:
                        discard(written)  # the new state is written and does not read it
                    written = new
                if self.done:
                    self.done(turn, state)
                if converged:
                    break
        finally:
            prepared.unpersist()
        return Result(state, turn, distance, converged)


def total_distance(old: DataFrame, new: DataFrame, distance: Column | None = None) -> float:
    """The sum of distances over all keys of either state."""
    both = old.select("dk", F.col("dv").alias("prev")).join(new.select("dk", F.col("dv").alias("curr")), "dk", "full")
    each = F.abs(F.coalesce("curr", F.lit(0.0)) - F.coalesce("prev", F.lit(0.0))) if distance is None else distance
    return float(both.agg(F.sum(each).alias("d")).first()["d"] or 0.0)


def largest_move(old: DataFrame, new: DataFrame) -> float:
    """The greatest difference of a key; a key in one state only moved by any measure."""
    both = old.select("dk", F.col("dv").alias("prev")).join(new.select("dk", F.col("dv").alias("curr")), "dk", "full")
    return float(both.agg(F.max(F.coalesce(F.abs(F.col("curr") - F.col("prev")), F.lit(float("inf")))).alias("d")).first()["d"] or 0.0)


def identity_map(paired: DataFrame) -> DataFrame:
    """(static key, state value) of every pair."""
    return paired.select(F.col("sk").alias("k"), F.col("dv").alias("v"))


def identity_step(paired: DataFrame, state: DataFrame) -> DataFrame:
    """The identity map and reduce of a step: the state as it was."""
    return state.select("dk", "dv")


def identity_easy_reduce(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """The reducer of an incremental step that changes nothing: rows of the new result,
    and of the old one where there is no new one."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def compare_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """``n, total, mean, most, most_at`` of absolute differences by key ``dk``, and
    ``unmatched``, the keys in one of the two only."""
    both = a.select("dk", F.col("dv").alias("x")).join(b.select("dk", F.col("dv").alias("y")), "dk", "full")
    gap = F.abs(F.col("x") - F.col("y"))
    return both.select("dk", gap.alias("gap"), (F.col("x").isNull() | F.col("y").isNull()).alias("alone")).agg(
        F.count("gap").alias("n"),
        F.sum("gap").alias("total"),
        F.avg("gap").alias("mean"),
        F.max("gap").alias("most"),
        F.max_by("dk", F.struct("gap", -F.col("dk"))).alias("most_at"),
        F.count_if("alone").alias("unmatched"),
    )


def distribute(static: DataFrame, state: DataFrame, parts: int, path: str, kind: str = "double") -> tuple[str, str]:
    """Text rows ``key, value`` of static and state data as co-partitioned tables:
    int keys, the state's values cast to ``kind``; the same parts for both."""
    out = []
    for name, frame, cast in (("static", static, "string"), ("state", state, kind)):
        rows = frame.select(F.col("key").try_cast("int").alias("key"), F.col("value").try_cast(cast).alias("value"))
        target = f"{path}/{name}"
        rows.repartition(parts, "key").sortWithinPartitions("key").write.mode("errorifexists").parquet(target)
        out.append(target)
    return out[0], out[1]
