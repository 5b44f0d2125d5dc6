"""Text functions: tokens, matches, key-value lines and small codecs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The separators between tokens: space, tab, newline, carriage return, form feed.
SPACE = r"[ \t\n\r\f]+"


def tokens(text: Column) -> Column:
    """The tokens of a text, without empty ones."""
    return F.filter(F.split(text, SPACE), lambda word: word != "")


def explode_tokens(df: DataFrame, column: str, name: str = "word") -> DataFrame:
    return df.select(F.explode(tokens(F.col(column))).alias(name))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The group of every match, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def line_per_match(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """The whole line once for every match in it."""
    return df.select(F.explode(F.array_repeat(F.col(column), F.regexp_count(F.col(column), F.lit(pattern)))).alias(column))


def split_key_value(line: Column, separator: str = "\t", key_fields: int = 1) -> tuple[Column, Column]:
    """Key and value at the separator that follows ``key_fields`` fields; without
    one the key is the whole line and the value empty."""
    at = F.length(F.substring_index(line, separator, key_fields))
    cut = at < F.length(line)
    return F.when(cut, F.substring(line, F.lit(1), at)).otherwise(line), F.when(cut, F.substring(line, at + len(separator) + 1, F.length(line))).otherwise("")


def sparse_vector(text: Column) -> Column:
    """``dim,val dim,val`` as a map from dimension to value."""
    pairs = F.filter(F.split(text, " "), lambda x: x != "")
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split(x, ",")[0].cast("int").alias("key"), F.split(x, ",")[1].cast("double").alias("value"))))


def sparse_text(vector: Column) -> Column:
    """The map as text, in order of dimension."""
    entries = F.array_sort(F.map_entries(vector))
    return F.concat(F.array_join(F.transform(entries, lambda e: F.concat_ws(",", e["key"].cast("string"), e["value"].cast("string"))), " "), F.lit(" "))


def percent_decoded(text: Column) -> Column:
    return F.url_decode(text)


def quote(text: str) -> str:
    """A pattern that matches exactly this text."""
    return re.escape(text)
