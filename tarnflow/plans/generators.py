"""Data and delta generators, deterministic: a choice for key k is arithmetic on k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def chosen(key: Column, percent: int) -> Column:
    """Whether a key is among ``percent`` of a hundred."""
    return (key * 7919 + 13) % 100 < percent


def uniform(key: Column, salt: int) -> Column:
    """A number in [0, 1) from a key."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def normal(key: Column, salt: int) -> Column:
    """A standard normal number from a key (Box and Muller)."""
    return F.sqrt(-2.0 * F.log(1.0 - uniform(key, salt))) * F.cos(2 * 3.141592653589793 * uniform(key, salt + 1))


def lognormal(key: Column, salt: int, mu: float = 0.0, sigma: float = 1.0) -> Column:
    return F.exp(F.lit(mu) + F.lit(sigma) * normal(key, salt))


def update_delta(df: DataFrame, key: str, value: str, new: Column, changed: Column, deleted: Column | None = None) -> DataFrame:
    """``key, value, op``: for changed rows the old value with ``-`` and the new one
    with ``+``; for deleted rows ``-`` alone."""
    gone = F.lit(False) if deleted is None else deleted
    ops = F.when(gone, F.array(F.struct(F.col(value).alias("value"), F.lit("-").alias("op")))).otherwise(
        F.array(F.struct(F.col(value).alias("value"), F.lit("-").alias("op")), F.struct(new.alias("value"), F.lit("+").alias("op")))
    )
    return df.filter(gone | changed).select(F.col(key).alias("key"), F.explode(ops).alias("o")).select("key", "o.value", "o.op")


def update_links(adjacency: DataFrame, nodes: int, percent: int, delete: bool = False) -> DataFrame:
    """Delta of text link lists ``src, links``: a target more for some nodes;
    optionally the nodes 0, 100, ..., 900 go."""
    new = F.concat("links", ((F.col("src") * 31 + 7) % nodes).cast("string"), F.lit(" "))
    gone = (F.col("src") % 100 == 0) & (F.col("src") < 1000) if delete else None
    return update_delta(adjacency, "src", "links", new, chosen(F.col("src"), percent), gone)


def update_weights(edges: DataFrame, percent: int) -> DataFrame:
    """Delta of weighted links ``src, dst, w``: a new weight for some of them."""
    new = F.round(lognormal(F.col("src") * 1000003 + F.col("dst"), 3, 0.4, 1.2), 6)
    rows = edges.select("src", "dst", F.array(F.struct(F.col("w"), F.lit("-").alias("op")), F.struct(new.alias("w"), F.lit("+").alias("op"))).alias("o"))
    return rows.filter(chosen(F.col("src") * 31 + F.col("dst"), percent)).select("src", "dst", F.explode("o").alias("o")).select("src", "dst", "o.w", "o.op")


def update_matrix(matrix: DataFrame, percent: int) -> DataFrame:
    """Entries ``i, j, m`` with a new value and ``op`` ``+`` for some, unchanged and
    without ``op`` for the others."""
    pick = chosen(F.col("i") * 31 + F.col("j"), percent)
    return matrix.select("i", "j", F.when(pick, F.round(uniform(F.col("i") * 1000003 + F.col("j"), 5), 6)).otherwise(F.col("m")).alias("m"), F.when(pick, F.lit("+")).alias("op"))


def update_points(points: DataFrame, percent: int, delete: int, add: int) -> DataFrame:
    """Delta of sparse points ``id, vector`` (a map): values moved for some points,
    ``delete`` percent gone, ``add`` percent new."""
    moved = F.transform_values("vector", lambda d, v: v + F.round(uniform(F.col("id") * 1009 + d, 9) * 2 - 1, 6))
    delta = update_delta(points, "id", "vector", moved, chosen(F.col("id"), percent), chosen(F.col("id") + 1, delete))
    largest = points.agg(F.max("id").alias("top"))
    new = points.filter(chosen(F.col("id") + 2, add)).crossJoin(F.broadcast(largest)).select((F.col("id") + F.col("top") + 1).alias("key"), F.col("vector").alias("value"), F.lit("+").alias("op"))
    return delta.unionByName(new)


def generate_links(spark: SparkSession, nodes: int, mean: float = 2.0, weighted: bool = False, most: int = 1000) -> DataFrame:
    """``src, dst`` (and ``w``): lognormal out-degrees of at most ``most``."""
    degree = F.least(F.greatest(F.floor(lognormal(F.col("id"), 1, 0.5, 1.0) * mean / 2).cast("int"), F.lit(1)), F.lit(most))
    rows = spark.range(nodes).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), degree)).alias("k"))
    target = F.pmod(F.xxhash64("src", "k", F.lit(2)), F.lit(nodes))
    out = rows.select("src", target.alias("dst"), "k")
    weight = F.round(lognormal(F.col("src") * 1009 + F.col("k"), 4, 0.4, 1.2), 6)
    return out.withColumn("w", weight).drop("k") if weighted else out.drop("k")


def generate_points(spark: SparkSession, points: int, dimensions: int, filled: int) -> DataFrame:
    """Sparse points ``id, vector`` with values 1 to 500."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(filled - 1)), lambda k: F.struct((k * (dimensions // filled) + F.pmod(F.xxhash64("id", k), F.lit(max(1, dimensions // filled)))).cast("int").alias("d"), (1 + F.pmod(F.xxhash64("id", k, F.lit(1)), F.lit(500))).cast("double").alias("v")))
    return spark.range(points).select("id", F.map_from_entries(pairs).alias("vector"))


def generate_matrix(spark: SparkSession, size: int, per_row: int) -> tuple[DataFrame, DataFrame]:
    """Entries ``i, j, m`` and a start vector ``dk, dv`` of 0.001."""
    rows = spark.range(size).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("k"))
    entries = rows.select("i", F.pmod(F.xxhash64("i", "k"), F.lit(size)).alias("j"), F.round(uniform(F.col("i") * 1009 + F.col("k"), 6), 6).alias("m")).dropDuplicates(["i", "j"])
    return entries, spark.range(size).select(F.col("id").alias("dk"), F.lit(0.001).alias("dv"))


def generate_factors(spark: SparkSession, rows: int, width: int) -> DataFrame:
    """``i, values``: dense positive rows divided by their greatest value plus one."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.floor(uniform(F.col("id") * 1009 + k, 7) * 100))
    return spark.range(rows).withColumn("raw", raw).select(F.col("id").alias("i"), F.transform("raw", lambda x: x / (F.array_max("raw") + 1)).alias("values"))


def tera_rows(spark: SparkSession, n: int) -> DataFrame:
    """``key, value``: ten printable characters, then a number and filler."""
    letters = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.char((32 + F.pmod(F.xxhash64("id", k), F.lit(95))).cast("int")))
    filler = F.repeat(F.char((65 + F.pmod("id", F.lit(26))).cast("int")), 78)
    return spark.range(n).select(F.array_join(letters, "").alias("key"), F.concat(F.lpad(F.col("id").cast("string"), 10, " "), filler).alias("value"))


def random_pairs(spark: SparkSession, n: int, key_bytes: int = 10, value_bytes: int = 20) -> DataFrame:
    """Random hex keys and values."""
    return spark.range(n).select(F.substring(F.sha2(F.concat(F.lit("k"), F.col("id").cast("string")), 256), 1, key_bytes).alias("key"), F.substring(F.sha2(F.concat(F.lit("v"), F.col("id").cast("string")), 256), 1, value_bytes).alias("value"))


def sum_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The sum of all lines as numbers."""
    return lines.agg(F.sum(F.col(column).try_cast("double")).alias("total"))
