"""Typed aggregates in one pass, value histograms and running statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.text import split_key_value
from tarnflow.storage import materialize

#: Types that :func:`aggregate` knows.
TYPES = ("LongValueSum", "DoubleValueSum", "LongValueMax", "LongValueMin", "StringValueMax", "StringValueMin", "UniqValueCount", "ValueHistogram")


@dataclass(frozen=True)
class Emit:
    """One aggregate of a job: its type, and per row the group id and the value."""

    kind: str
    id: Column
    value: Column


def record_count() -> Emit:
    """The default aggregate: how many records there are."""
    return Emit("LongValueSum", F.lit("record_count"), F.lit(1))


def file_record_count() -> Emit:
    """Records of each input file."""
    return Emit("LongValueSum", F.input_file_name(), F.lit(1))


#: How types that combine value by value come from text values.
COMBINED = {
    "LongValueSum": lambda v: F.sum(v.try_cast("long")),
    "DoubleValueSum": lambda v: F.sum(v.try_cast("double")),
    "LongValueMax": lambda v: F.max(v.try_cast("long")),
    "LongValueMin": lambda v: F.min(v.try_cast("long")),
    "StringValueMax": F.max,
    "StringValueMin": F.min,
}


def aggregate(df: DataFrame, emits: list[Emit], most_unique: int | None = None, plugins: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``type, id, result`` (text) of several aggregates, each with its own groups.

    The rows are unpivoted once. Sums, greatest and least values are partial aggregates
    by (type, id); only unique counts and histograms go by (type, id, value), counted
    first, which combines in every task, also for very common ids. ``most_unique``
    reports at most that many unique values and one more. ``plugins`` are types of the
    caller's: an aggregate of the text values by name.
    """
    combined = COMBINED | (plugins or {})
    unknown = [e.kind for e in emits if e.kind not in TYPES and e.kind not in combined]
    if unknown:
        raise ValueError(f"unknown aggregate types {unknown}")
    results = []
    direct = [e for e in emits if e.kind in combined]
    if direct:
        value, kind = F.col("value"), F.col("type")
        kinds = list(dict.fromkeys(e.kind for e in direct))
        each = [combined[k](F.when(kind == k, value)).cast("string").alias(f"r{n}") for n, k in enumerate(kinds)]
        chosen = F.coalesce(*(F.when(kind == k, F.col(f"r{n}")) for n, k in enumerate(kinds)))
        results.append(_unpivoted(df, direct).groupBy("type", "id").agg(*each).select("type", "id", chosen.alias("result")))
    by_value = [e for e in emits if e.kind not in combined]
    if by_value:
        counted = _unpivoted(df, by_value).groupBy("type", "id", "value").agg(F.count("*").alias("n"))
        if any(e.kind == "UniqValueCount" for e in by_value):
            results.append(_unique_text(counted, most_unique))
        if any(e.kind == "ValueHistogram" for e in by_value):
            results.append(_histogram_text(counted))
    out = results[0]
    for result in results[1:]:
        out = out.unionByName(result)
    return out


def _unpivoted(df: DataFrame, emits: list[Emit]) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(e.kind).alias("type"), e.id.cast("string").alias("id"), e.value.cast("string").alias("value")) for e in emits)))
    return df.select(rows.alias("e")).select("e.*").filter("value IS NOT NULL")


def aggregate_lines(lines: DataFrame, column: str = "value", most_unique: int | None = None) -> DataFrame:
    """The reducer of ``Type:id<tab>value`` lines, as external mappers write them; lines
    of another form are an error."""
    key, value = split_key_value(F.col(column))
    kind, name = F.substring_index(key, ":", 1), F.expr(f"substring({column}, instr({column}, ':') + 1)")
    known = kind.isin(*TYPES) & (F.instr(key, ":") > 0)
    checked = F.when(known, kind).otherwise(F.raise_error(F.concat(F.lit("not an aggregate: "), key)))
    rows = lines.select(checked.alias("type"), split_key_value(name)[0].alias("id"), value.alias("value")).filter("value IS NOT NULL")
    # the lines are read once, also where they come from a process: all types combine in
    # one pass, by value where a type needs that
    kind, each = F.col("type"), [combine(F.when(F.col("type") == k, F.col("value"))).cast("string").alias(f"r{n}") for n, (k, combine) in enumerate(COMBINED.items())]
    split = rows.withColumn("__value", F.when(~kind.isin(*COMBINED), F.col("value")))
    once = materialize(split.groupBy("type", "id", "__value").agg(*each, F.count("*").alias("n")), "aggregated")
    chosen = F.coalesce(*(F.when(kind == k, F.col(f"r{n}")) for n, k in enumerate(COMBINED)))
    direct = once.filter(kind.isin(*COMBINED)).select("type", "id", chosen.alias("result"))
    counted = once.filter(~kind.isin(*COMBINED)).select("type", "id", F.col("__value").alias("value"), "n")
    return direct.unionByName(_unique_text(counted, most_unique)).unionByName(_histogram_text(counted))


def _unique_text(counted: DataFrame, most_unique: int | None) -> DataFrame:
    unique = F.count("*") if most_unique is None else F.least(F.count("*"), F.lit(most_unique + 1))
    return counted.filter(F.col("type") == "UniqValueCount").groupBy("type", "id").agg(unique.cast("string").alias("result"))


def _histogram_text(counted: DataFrame) -> DataFrame:
    """Number of values, then of their counts the least, median, greatest, mean and
    population deviation, as tab-separated text."""
    stats = value_histogram(counted.filter(F.col("type") == "ValueHistogram"), ["type", "id"], "value", F.col("n"))
    return stats.select("type", "id", F.concat_ws("\t", *(F.col(c).cast("string") for c in ("n", "least", "median", "most", "mean", "deviation"))).alias("result"))


def value_histogram(df: DataFrame, group: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """By group over the counts of its distinct values: ``n, least, median, most,
    mean, deviation`` (population).

    The median is the count at place ``n // 2`` of the sorted counts. It is found
    from the counts of counts, of which there are few.
    """
    weight = F.lit(1) if weight is None else weight
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.sum(weight).cast("long").alias("c"))
    of_counts = counts.groupBy(*group, "c").agg(F.count("*").alias("m"))
    listed = F.array_sort(F.collect_list(F.struct("c", "m")))
    stats = of_counts.groupBy(*group).agg(
        F.sum("m").alias("n"),
        F.min("c").alias("least"),
        F.max("c").alias("most"),
        (F.sum(F.col("c") * F.col("m")) / F.sum("m")).alias("mean"),
        (F.sum(F.col("c") * F.col("c") * F.col("m")) / F.sum("m")).alias("__square"),
        listed.alias("__listed"),
    )
    place = F.floor(F.col("n") / 2)
    found = F.aggregate(
        F.col("__listed"),
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
        lambda acc, x: F.struct((acc["seen"] + x["m"]).alias("seen"), F.when(acc["at"].isNull() & (acc["seen"] + x["m"] > place), x["c"]).otherwise(acc["at"]).alias("at")),
    )
    deviation = F.sqrt(F.greatest(F.col("__square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return stats.select(*group, "n", "least", found["at"].alias("median"), "most", "mean", deviation.alias("deviation"))


def histogram_detail(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``value, n`` of each distinct value by group."""
    return df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))


def unique_count(df: DataFrame, group: list[str], value: str, most: int | None = None) -> DataFrame:
    """Exact distinct values by group; with ``most`` at most ``most + 1`` are reported."""
    counted = F.count_distinct(value)
    return df.groupBy(*group).agg((F.least(counted, F.lit(most + 1)) if most is not None else counted).cast("long").alias("uniq"))


def sample_stat(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Number, mean, sample variance and deviation, least and greatest."""
    return df.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def moving_stats(df: DataFrame, time: str, value: Column, windows: dict[str, str], now: Column | None = None) -> DataFrame:
    """Totals since the start and over the last ``windows`` (name to interval)
    before ``now`` (by default the latest time)."""
    latest = df.agg(F.max(time).alias("__now"))
    rows = df.withColumn("__now", now) if now is not None else df.crossJoin(F.broadcast(latest))  # one row
    last = [F.sum(F.when(F.col(time) > F.col("__now") - F.expr(f"INTERVAL {span}"), value)).alias(name) for name, span in windows.items()]
    return rows.agg(F.sum(value).alias("since_start"), *last)


def bucket_totals(df: DataFrame, time: str, value: Column, seconds: int) -> DataFrame:
    """``bucket, total``: totals by buckets of so many seconds, which moving counters keep."""
    return df.groupBy(F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000)).cast("long").alias("bucket")).agg(F.sum(value).alias("total"))


def merge_buckets(*totals: DataFrame) -> DataFrame:
    """The buckets after an update: as many rows as buckets, however many updates."""
    out = totals[0]
    for more in totals[1:]:
        out = out.unionByName(more)
    return out.groupBy("bucket").agg(F.sum("total").alias("total"))


def bucketed_stats(buckets: DataFrame, seconds: int, spans: dict[str, int], now: int | None = None) -> DataFrame:
    """Totals since the start and over the last ``spans`` (seconds, whole buckets) up to
    the bucket ``now`` (by default the last one)."""
    rows = buckets.withColumn("__now", F.lit(now)) if now is not None else buckets.crossJoin(F.broadcast(buckets.agg(F.max("bucket").alias("__now"))))  # one row
    last = [F.sum(F.when(F.col("bucket") > F.col("__now") - span // seconds, F.col("total"))).alias(name) for name, span in spans.items()]
    return rows.agg(F.sum("total").alias("since_start"), *last)


def size_estimate(df: DataFrame, output: Column, total_rows: int, share: float = 0.1) -> DataFrame:
    """Estimated output size of all rows, from the bytes of a share of them."""
    seen = df.sample(fraction=share, seed=7).agg(F.count("*").alias("n"), F.sum(F.length(output)).alias("bytes"))
    return seen.select((F.col("bytes") / F.greatest("n", F.lit(1)) * F.lit(total_rows)).cast("long").alias("estimate"))
