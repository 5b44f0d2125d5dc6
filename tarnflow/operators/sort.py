"""Total order, secondary order, key-spec order, checks of order, and top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.fields import byte_range, partition_columns, sort_columns
from tarnflow.functions.sketches import running_total


def total_order(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Range partitions by sampled split points, each of them sorted."""
    return df.orderBy(*keys)


def range_partitions(df: DataFrame, key: str, points: list) -> DataFrame:
    """``df`` with ``partition``: how many of the ascending split points are at
    most the key. Equal or descending points are an error."""
    if any(a >= b for a, b in zip(points, points[1:])):
        raise ValueError("split points must ascend")
    low = F.lit(0)
    return df.withColumn("partition", _search(F.col(key), points, 0, len(points)) if points else low)


def _search(key: Column, points: list, low: int, high: int) -> Column:
    """Binary search as nested conditions: depth log2 of the number of points."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(key < F.lit(points[middle]), _search(key, points, low, middle)).otherwise(_search(key, points, middle + 1, high))


def split_points(df: DataFrame, key: str, parts: int, most: int = 100_000, seed: int = 1) -> list:
    """Split points for ``parts`` ranges from a random sample of about ``most`` keys of
    all partitions."""
    rows = df.select(key).filter(F.col(key).isNotNull())
    keys = sorted(r[0] for r in random_sample(rows, min(1.0, most / max(1, rows.count())), seed).collect())
    step = len(keys) / parts
    return list(dict.fromkeys(keys[round(step * k)] for k in range(1, parts) if round(step * k) < len(keys)))


def random_sample(df: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """Each row with the same chance, whatever its partition."""
    return df.sample(fraction=share, seed=seed)


def split_sample(df: DataFrame, each: int) -> DataFrame:
    """The first ``each`` rows of every split."""
    return df.filter(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) < each)


def binary_partition(df: DataFrame, data: str, parts: int, left: int = 0, right: int = -1) -> DataFrame:
    """``df`` dealt by a hash of a range of the key's bytes."""
    return df.repartition(parts, byte_range(F.col(data), left, right))


def interval_sample(df: DataFrame, order: str, every: int) -> DataFrame:
    """Every n-th row of a unique order, the first included."""
    placed = running_total(df.withColumn("__one", F.lit(1)), order, "__one")
    return placed.filter((F.col("running") - 1) % every == 0).drop("__one", "running")


def secondary_sort(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows of a group together and in order, within hash partitions."""
    return df.repartition(*group).sortWithinPartitions(*group, *order)


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """The place of each row in its group's order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def key_sort(df: DataFrame, line: str, spec: str, separator: str = "\t") -> DataFrame:
    """Rows in order of a Unix-style key spec, then of the whole line."""
    return df.orderBy(*sort_columns(F.col(line), spec, separator), F.col(line).asc_nulls_first())


def key_partition(df: DataFrame, line: str, spec: str, parts: int, separator: str = "\t") -> DataFrame:
    return df.repartition(parts, *partition_columns(F.col(line), spec, separator))


def column_sort(df: DataFrame, line: str, columns: list[int], separator: str = "\t") -> DataFrame:
    """Lines by the fields of these numbers, then by the whole line."""
    fields = F.split(line, separator)
    return df.orderBy(*(F.get(fields, F.lit(k)).asc_nulls_first() for k in columns), line)


def order_breaks(df: DataFrame, file: str, place: str, key: str) -> DataFrame:
    """Where a file's key is below the one before it, and where a file starts
    below the end of the file before it: ``kind, file, key, before``."""
    inside = Window.partitionBy(file).orderBy(place)
    rows = df.select(F.col(file).alias("file"), F.col(key).alias("key"), F.lag(key).over(inside).alias("before"))
    within = rows.filter("key < before").select(F.lit("record").alias("kind"), "file", "key", "before")
    ends = df.groupBy(F.col(file).alias("file")).agg(F.min_by(key, place).alias("key"), F.max_by(key, place).alias("last"))
    files = ends.select("file", "key", F.lag("last").over(Window.orderBy("file")).alias("before"))  # a row for each file
    return within.unionByName(files.filter("key < before").select(F.lit("file").alias("kind"), "file", "key", "before"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of an order: each task keeps k rows."""
    return df.orderBy(*order).limit(k)


def count_descending(df: DataFrame, column: str) -> DataFrame:
    """Values with their counts, the most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), column)
