"""Writers. An existing target is an error, as for every batch job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.sources.global_state import format_global


def key_value_lines(df: DataFrame, key: str = "key", value: str = "value", separator: str = "\t") -> DataFrame:
    """``key<sep>value`` lines; a null side drops the separator too, and a row with
    both null has no line."""
    kept = df.filter(F.col(key).isNotNull() | F.col(value).isNotNull())
    return kept.select(F.concat_ws(separator, F.col(key).cast("string"), F.col(value).cast("string")).alias("value"))


def write_key_value(df: DataFrame, path: str, separator: str = "\t", compression: str | None = None) -> None:
    writer = key_value_lines(df, separator=separator).write.mode("errorifexists")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_typed(df: DataFrame, path: str) -> None:
    """Typed key-value rows in a columnar file, which reads back as it was."""
    df.write.mode("errorifexists").parquet(path)


def write_sequence(df: DataFrame, path: str) -> None:
    """A binary key-value container of two columns."""
    df.rdd.map(tuple).saveAsSequenceFile(path)


BINARY_WRITER = "org.apache.hadoop.mapreduce.lib.output.SequenceFileAsBinaryOutputFormat"
BYTES_CLASS = "org.apache.hadoop.io.BytesWritable"


def write_sequence_as_binary(df: DataFrame, path: str, key_class: str, value_class: str) -> None:
    """A container whose keys and values are the given bytes, declared as two types."""
    prefix = "mapreduce.output.seqbinaryoutputformat"
    conf = {f"{prefix}.key.class": key_class, f"{prefix}.value.class": value_class}
    rows = df.rdd.map(lambda r: (bytearray(r[0]), bytearray(r[1])))
    rows.saveAsNewAPIHadoopFile(path, BINARY_WRITER, BYTES_CLASS, BYTES_CLASS, conf=conf)


def write_set_file(df: DataFrame, path: str, key: str, parts: int) -> None:
    """The distinct keys alone, in order."""
    write_map_file(df.select(key).distinct(), path, key, parts)


def write_array_file(df: DataFrame, path: str, order: str, parts: int) -> None:
    """Rows by their ``index`` from 0 on in a unique order, for reads by place."""
    from tarnflow.functions.sketches import running_total

    placed = running_total(df.withColumn("__one", F.lit(1)), order, "__one")
    write_map_file(placed.withColumn("index", (F.col("running") - 1).cast("long")).drop("__one", "running"), path, "index", parts)


def write_map_file(df: DataFrame, path: str, key: str, parts: int) -> None:
    """Sorted by key within parts, so that readers skip row groups on a lookup."""
    df.repartition(parts, key).sortWithinPartitions(key).write.mode("errorifexists").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of one key of a map file; the filter reaches the files."""
    return spark.read.parquet(path).filter(F.col(key) == F.lit(value))


def write_by(df: DataFrame, path: str, name: Column, kind: str = "parquet") -> None:
    """A folder for each name that the rows give."""
    df.withColumn("name", name).write.mode("errorifexists").partitionBy("name").format(kind).save(path)


def write_named(df: DataFrame, outputs: dict[str, tuple[Column, str]]) -> None:
    """Named side outputs: for each (condition, path) the rows that meet it, if any."""
    for condition, path in outputs.values():
        part = df.filter(condition)
        if not part.isEmpty():  # no file without a record
            part.write.mode("errorifexists").parquet(path)


def write_global(state: DataFrame, path: str, separator: str = "\t") -> None:
    format_global(state, separator).write.mode("errorifexists").text(path)


def write_tera(df: DataFrame, path: str) -> None:
    """Key and value as lines that end with carriage return and newline."""
    df.select(F.concat("key", "value").alias("value")).write.mode("errorifexists").option("lineSep", "\r\n").text(path)


def discard(df: DataFrame) -> None:
    """Run everything and keep nothing."""
    df.write.format("noop").mode("overwrite").save()
