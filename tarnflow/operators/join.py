"""Joins of several sources: inner, outer, override, tagged, and join expressions.

All are equi-joins on one or more keys; Spark sorts and merges co-partitioned
tables (bucketed ones without a shuffle), broadcasts what its own size estimate
allows, and splits skewed partitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tupled(frame: DataFrame, key: list[str], name: str) -> DataFrame:
    return frame.select(*key, F.struct(*(c for c in frame.columns if c not in key)).alias(name))


def inner_join(sources: list[DataFrame], key: list[str], most: int | None = None) -> DataFrame:
    """Keys that every source has, with the cross product of their rows; the
    source k's other columns are the struct ``s<k>``. With ``most``, a key that makes
    more rows than that is dealt to as many tasks as it takes."""
    frames = (_tupled(s, key, f"s{k}") for k, s in enumerate(sources))
    return reduce(lambda a, b: a.join(b, key) if most is None else _spread_join(a, b, key, most), frames)


def _spread_join(a: DataFrame, b: DataFrame, key: list[str], most: int) -> DataFrame:
    """An inner join of few keys with very many rows: the side with more rows of a key
    is cut into pieces, the other goes to each of them. Skew splitting goes by the rows
    that are read and does not see a product; a piece makes about ``most`` rows."""
    left, right = (f.groupBy(*key).agg(F.count("*").alias(name)) for f, name in ((a, "__a"), (b, "__b")))
    pieces = F.least(F.ceil(F.col("__a") * F.col("__b") / most), F.greatest("__a", "__b")).alias("__pieces")
    heavy = left.join(right, key).select(*key, pieces, (F.col("__b") >= F.col("__a")).alias("__cut_b")).filter("__pieces > 1")
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(side: DataFrame, cut: Column) -> DataFrame:
        numbered = side.withColumn("__row", F.monotonically_increasing_id()).join(heavy, key, "left")
        one, each = F.array(F.pmod("__row", "__pieces")), F.sequence(F.lit(0).cast("long"), F.col("__pieces") - 1)
        own = F.when(F.col("__pieces").isNull(), F.array(F.lit(0).cast("long"))).when(cut, one).otherwise(each)
        return numbered.select(*side.columns, F.explode(own).alias("__piece")).repartition(n, *key, "__piece")

    return dealt(a, ~F.col("__cut_b")).join(dealt(b, F.col("__cut_b")), [*key, "__piece"]).drop("__piece")


def outer_join(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """All keys of any source; ``s<k>`` is null where source k has none."""
    return reduce(lambda a, b: a.join(b, key, "full"), (_tupled(s, key, f"s{k}") for k, s in enumerate(sources)))


def present(n: int) -> Column:
    """How many of the sources ``s0`` and on have the key."""
    return sum((F.col(f"s{k}").isNotNull().cast("int") for k in range(n)), F.lit(0))


def override_join(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Per key the rows of the last source that has it, all of them.

    Keys are found by a partial aggregate and joined back, so a key with very many
    rows is never sorted in one window.
    """
    tagged = [s.withColumn("__source", F.lit(k)) for k, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    top = rows.groupBy(*key).agg(F.max("__source").alias("__source"))
    return rows.join(top, [*key, "__source"]).drop("__source")


def multi_filter(joined: DataFrame, key: list[str], value: Column, name: str = "value") -> DataFrame:
    """One value from the tuple of each joined row; a null value drops it."""
    return joined.select(*key, value.alias(name)).filter(F.col(name).isNotNull())


def tagged_join(sources: dict[str, DataFrame], key: str, value: str, combine: Callable[[list[str]], Column] | None = None, least: int = 2, separator: str = "\t", most_values: int | None = None) -> DataFrame:
    """Cross product by key of the sources that have it, in order of tag; rows with
    fewer than ``least`` sources are dropped, and so are those whose combination is
    null. The default combination joins the values of the sources present. Of a source
    at most ``most_values`` values of a key take part, the first in order."""
    tags = sorted(sources)
    if most_values is not None:
        sources = {t: first_of_key(f, [key], [F.col(value)], most_values) for t, f in sources.items()}
    frames = [sources[t].select(F.col(key).alias("key"), F.struct(F.col(value).alias("v")).alias(t)) for t in tags]
    joined = reduce(lambda a, b: a.join(b, "key", "full"), frames)
    count = sum((F.col(t).isNotNull().cast("int") for t in tags), F.lit(0))
    made = combine(tags) if combine else F.concat_ws(separator, *(F.col(f"{t}.v").cast("string") for t in tags))
    return joined.filter(count >= least).select("key", made.alias("joined")).filter("joined IS NOT NULL")


Op = Callable[[list[DataFrame], list[str]], DataFrame]

#: Join operations by name; add to a copy of it for own ones.
OPERATIONS: dict[str, Op] = {"inner": inner_join, "outer": outer_join, "override": override_join}

TOKEN = re.compile(r'\s*([(),]|"[^"]*"|[^\s(),"]+)')


def join_expression(expression: str, read: Callable[[str, str], DataFrame], key: list[str], operations: dict[str, Op] | None = None) -> DataFrame:
    """A join tree such as ``inner(tbl(parquet,"a"),override(tbl(csv,"b"),tbl(csv,"c")))``;
    ``read`` opens the table of a format and path."""
    words = TOKEN.findall(expression)
    known = operations or OPERATIONS

    def take(expected: str | None = None) -> str:
        if not words or (expected and words[0] != expected):
            raise ValueError(f"expected {expected or 'a name'} at {' '.join(words[:4])!r}")
        return words.pop(0)

    def node() -> DataFrame:
        name = take()
        take("(")
        if name == "tbl":
            kind = take()
            take(",")
            path = take().strip('"')
            take(")")
            return read(kind, path)
        if name not in known:
            raise ValueError(f"unknown join operation {name!r}")
        children = [node()]
        while words and words[0] == ",":
            take(",")
            children.append(node())
        take(")")
        return known[name](children, key)

    tree = node()
    if words:
        raise ValueError(f"left over: {' '.join(words)!r}")
    return tree


def compose(operation: str, kind: str, *paths: str) -> str:
    """The expression of one operation over tables of one format."""
    return f"{operation}({','.join(f'tbl({kind},"{path}")' for path in paths)})"


def side_join(df: DataFrame, side: DataFrame, key: list[str], how: str = "left", most_bytes: int = 64 << 20) -> DataFrame:
    """A join with a small side table, sent to every task if its estimated size is
    small enough, else an ordinary join."""
    size = int(str(side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.join(F.broadcast(side) if size <= most_bytes else side, key, how)


def first_of_key(df: DataFrame, key: list[str], order: list[Column], rows: int = 1) -> DataFrame:
    """The first rows of each key in an order; each task keeps as many before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= rows).drop("__place")
