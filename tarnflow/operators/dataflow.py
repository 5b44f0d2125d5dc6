"""Maps, chains, counters, bad records and graphs of dependent jobs."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, *steps: Transform) -> DataFrame:
    """Mappers, at most one reducer, and mappers again: one plan, fused stages."""
    return reduce(lambda frame, step: step(frame), steps, df)


def inverse(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Key and value swapped."""
    return df.select(F.col(value).alias(key), F.col(key).alias(value))


def identity_reduce(df: DataFrame, key: str = "key") -> DataFrame:
    """All rows, duplicates too, sorted by key within partitions."""
    return df.repartition(key).sortWithinPartitions(key)


def by_source(frames: list[tuple[DataFrame, Transform]]) -> DataFrame:
    """A mapper of its own for each source, the results together."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (step(frame) for frame, step in frames))


def group_values(df: DataFrame, group: list[str], value: Column) -> DataFrame:
    """All values of each key as a list, sorted: for small groups."""
    return df.groupBy(*group).agg(F.sort_array(F.collect_list(value)).alias("values"))


def reduce_by(df: DataFrame, group: list[str], *aggregates: Column) -> DataFrame:
    """A reducer of combinable aggregates."""
    return df.groupBy(*group).agg(*aggregates)


def reduce_groups(df: DataFrame, group: list[str], work: Callable, schema: str) -> DataFrame:
    """An opaque reducer over whole groups in Arrow batches, for groups of bounded size."""
    return df.groupBy(*group).applyInPandas(work, schema)


def threaded_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, threads: int = 4) -> DataFrame:
    """A mapper that waits much (on a service, say): each task works on so many batches
    at a time, and hands them on in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            waiting: deque[Future] = deque()
            for batch in batches:
                waiting.append(pool.submit(work, batch))
                if len(waiting) >= threads:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()

    return df.mapInArrow(run, schema)


class Counters:
    """Named counters of a frame, merged over all tasks when it runs."""

    def __init__(self, **counters: Column) -> None:
        self.observation = Observation()
        self.columns = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in counters.items()]

    def watch(self, df: DataFrame) -> DataFrame:
        return df.observe(self.observation, *self.columns)

    @property
    def values(self) -> dict[str, int]:
        return dict(self.observation.get)


def skip_bad(df: DataFrame, **casts: tuple[Column, str]) -> tuple[DataFrame, DataFrame]:
    """(good rows with the cast columns, bad rows): a row is bad where a cast of a
    value that is there fails."""
    made = df
    for name, (column, kind) in casts.items():
        made = made.withColumn(f"__raw_{name}", column).withColumn(name, column.try_cast(kind))
    bad = reduce(lambda a, b: a | b, (F.col(f"__raw_{name}").isNotNull() & F.col(name).isNull() for name in casts))
    raw = [f"__raw_{name}" for name in casts]
    return made.filter(~bad).drop(*raw), made.filter(bad).select(*df.columns)


@dataclass
class Job:
    """A named piece of work that waits for others."""

    name: str
    work: Callable[[], object]
    after: list[str] = field(default_factory=list)


def run_jobs(jobs: list[Job], parallel: int = 4) -> dict[str, str]:
    """Run jobs as soon as what they wait for has succeeded; the state of each:
    SUCCESS, FAILED, or DEPENDENT_FAILED. Spark runs independent jobs side by side."""
    by_name = {job.name: job for job in jobs}
    missing = {name for job in jobs for name in job.after} - set(by_name)
    if missing or len(by_name) != len(jobs):
        raise ValueError(f"unknown or repeated jobs: {sorted(missing)}")
    state: dict[str, str] = {}
    running: dict[Future, str] = {}
    with ThreadPoolExecutor(parallel) as pool:
        while len(state) < len(jobs):
            for name, job in by_name.items():
                if name in state or name in running.values():
                    continue
                if any(state.get(x) in ("FAILED", "DEPENDENT_FAILED") for x in job.after):
                    state[name] = "DEPENDENT_FAILED"
                elif all(state.get(x) == "SUCCESS" for x in job.after):
                    running[pool.submit(job.work)] = name
            if running:
                for future in wait(running, return_when=FIRST_COMPLETED).done:
                    state[running.pop(future)] = "FAILED" if future.exception() else "SUCCESS"
            elif len(state) < len(jobs) and not any(all(state.get(x) == "SUCCESS" for x in j.after) or any(state.get(x) in ("FAILED", "DEPENDENT_FAILED") for x in j.after) for n, j in by_name.items() if n not in state):
                raise ValueError("jobs wait for each other")
    return state
