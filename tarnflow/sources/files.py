"""Readers of text, key-value and binary files, and record filters over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.functions.text import split_key_value

#: Keys and values of lines without a separator.
MAX_INT = 2147483647
MAX_FLOAT = 3.4028234663852886e38


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, whole: bool = False) -> DataFrame:
    """``value`` of every line; compressed files by suffix; ``glob`` filters names."""
    return spark.read.text(path, wholetext=whole, pathGlobFilter=glob)


def read_key_value(spark: SparkSession, path: str, separator: str = "\t", key_fields: int = 1) -> DataFrame:
    """``key, value`` of lines; without a separator the line is the key."""
    key, value = split_key_value(F.col("value"), separator, key_fields)
    return read_lines(spark, path).select(key.alias("key"), value.alias("value"))


def read_int_key_value(spark: SparkSession, path: str, kind: str = "string", separator: str = "\t") -> DataFrame:
    """``key int, value`` of type ``string``, ``float`` or ``double``; a line without
    separator has the largest int as key, and an empty or the largest float value."""
    line = F.col("value")
    key, value = split_key_value(line, separator)
    whole = F.instr(line, separator) == 0
    missing = F.lit("") if kind == "string" else F.lit(MAX_FLOAT).cast(kind)
    return read_lines(spark, path).select(
        F.when(whole, F.lit(MAX_INT)).otherwise(key.try_cast("int")).alias("key"),
        F.when(whole, missing).otherwise(value if kind == "string" else value.try_cast(kind)).alias("value"),
    )


def read_records_with_offsets(spark: SparkSession, path: str, separator: str = "\n", most_bytes: int | None = None) -> DataFrame:
    """``file, offset, value, ended`` of the records that ``separator`` ends: the byte
    place of each in its file, and whether the separator follows it.

    Files are split as usual; a record's place is the bytes of the file's splits before
    and of the records before it in its split. Records of more than ``most_bytes`` are
    left out.
    """
    rows = spark.read.option("lineSep", separator).text(path).select(
        F.input_file_name().alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"
    )
    gap = len(separator.encode("utf-8"))
    rows = rows.withColumn("bytes", F.octet_length("value").cast("long") + gap)
    totals = rows.groupBy("file", "block").agg(F.sum("bytes").alias("total"))
    earlier = F.sum("total").over(Window.partitionBy("file").orderBy("block")) - F.col("total")  # a row for each split
    inside = F.sum("bytes").over(Window.partitionBy("file", "block").orderBy("id")) - F.col("bytes")
    placed = rows.withColumn("inside", inside).join(totals.select("file", "block", earlier.alias("earlier")), ["file", "block"])
    offset = F.col("earlier") + F.col("inside")
    out = placed.select("file", offset.alias("offset"), "value", (offset + F.col("bytes") <= F.col("size")).alias("ended"))
    return out if most_bytes is None else out.filter(F.octet_length("value") <= most_bytes)


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` with line numbers from 0 within each file.

    Files are split as usual; the numbers of a file's splits are joined by the
    counts of the splits before, so no file has to fit in a task.
    """
    rows = read_lines(spark, path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    starts = counts.select("file", "block", "first", before.alias("before"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def read_n_lines(spark: SparkSession, path: str, n: int = 1) -> DataFrame:
    """Lines with the number of their chunk of ``n`` lines within the file."""
    return number_lines(spark, path).withColumn("chunk", F.floor(F.col("line") / n))


def read_xml(spark: SparkSession, path: str, begin: str, end: str) -> DataFrame:
    """``value``: each stretch from a begin mark to the next end mark, both included.

    The end mark separates records, so files are split like lines, anywhere.
    """
    rows = read_records_with_offsets(spark, path, end).filter("ended")
    at = F.instr("value", begin)
    return rows.withColumn("at", at).filter("at > 0").select(F.concat(F.expr("substring(value, at)"), F.lit(end)).alias("value"))


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of a binary key-value container."""
    return spark.sparkContext.sequenceFile(path).toDF(["key", "value"])


BINARY_READER = "org.apache.hadoop.mapreduce.lib.input.SequenceFileAsBinaryInputFormat"
BYTES_CLASS = "org.apache.hadoop.io.BytesWritable"


def read_sequence_as_binary(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of a container as the bytes that were written, whatever their types."""
    rows = spark.sparkContext.newAPIHadoopFile(path, BINARY_READER, BYTES_CLASS, BYTES_CLASS)
    return spark.createDataFrame(rows.map(lambda kv: (bytes(kv[0]), bytes(kv[1]))), "key binary, value binary")


def read_sequence_as_text(spark: SparkSession, path: str) -> DataFrame:
    return read_sequence(spark, path).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Lines or container records, by the first bytes of the first file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    status = fs.getFileStatus(target)
    if status.isDirectory():
        files = [x for x in fs.listStatus(target) if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
        target = min((x.getPath() for x in files), key=lambda p: p.toString())
    stream = fs.open(target)
    try:
        head = bytes(max(0, stream.read()) for _ in range(3))
    finally:
        stream.close()
    return read_sequence(spark, path) if head == b"SEQ" else read_key_value(spark, path)


def read_inputs(spark: SparkSession, inputs: list[tuple[str, Callable[[SparkSession, str], DataFrame], Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Several paths, each with its own reader and transform, as one frame."""
    frames = [transform(read(spark, path)) for path, read, transform in inputs]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_tera(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of fixed lines: ten bytes of key, then the value."""
    return read_lines(spark, path).select(F.substring("value", 1, 10).alias("key"), F.expr("substring(value, 11)").alias("value"))


# Record filters over keys


def filter_regex(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """Rows whose whole key matches."""
    return df.filter(F.col(key).rlike(f"^(?:{pattern})$"))


def filter_percent(df: DataFrame, order: list[str], every: int = 10) -> DataFrame:
    """Records 1, f + 1, 2 f + 1, ... in an explicit order of rows (unique).

    Positions come from counts of ranges, not from one global window.
    """
    from tarnflow.functions.sketches import running_total

    placed = running_total(df.withColumn("__one", F.lit(1)).withColumn("__order", F.struct(*order)), "__order", "__one")
    return placed.filter((F.col("running") - 1) % every == 0).drop("__one", "__order", "running")


def md5_number(key: Column) -> Column:
    """The first eight bytes of the MD5 digest as a signed long."""
    digest = F.md5(key.cast("binary"))
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def filter_md5(df: DataFrame, key: str, every: int = 10) -> DataFrame:
    """Rows whose digest's number is divisible by ``every``."""
    return df.filter(md5_number(F.col(key)) % every == 0)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The replaceable map loop: a function over a whole split's batches."""
    return df.mapInArrow(work, schema)
