"""Global state: lines ``key<sep>id:record#id:record#...`` as a map of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.text import split_key_value
from tarnflow.sources.files import read_lines

KEY = "GlobalKey"


def parse_global(lines: DataFrame, column: str = "value", separator: str = "\t") -> DataFrame:
    """``id, record`` of every entry of every line."""
    _, value = split_key_value(F.col(column), separator)
    entries = lines.select(F.explode(F.filter(F.split(value, "#"), lambda x: x != "")).alias("entry"))
    parts = F.split("entry", ":", 2)
    return entries.select(parts[0].alias("id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("record"))


def merge_global(*states: DataFrame) -> DataFrame:
    """The union of partial maps; an id in two of them is an error."""
    out = states[0]
    for state in states[1:]:
        out = out.unionByName(state)
    counted = out.groupBy("id").agg(F.count("*").alias("n"), F.first("record").alias("record"))
    return counted.select("id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate id "), "id"))).otherwise(F.col("record")).alias("record"))


def format_global(state: DataFrame, separator: str = "\t") -> DataFrame:
    """One line for the whole state, which is small by its nature."""
    entries = F.array_sort(F.collect_list(F.struct("id", "record")))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["id"], F.lit(":"), e["record"], F.lit("#"))), "")
    return state.agg(F.concat(F.lit(KEY + separator), text).alias("value"))


def read_global(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    return parse_global(read_lines(spark, path), separator=separator)
