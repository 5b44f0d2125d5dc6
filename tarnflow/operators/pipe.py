"""External processes as mappers and reducers, over tab-separated lines."""

from __future__ import annotations

import subprocess
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.text import split_key_value
from tarnflow.sources.sinks import key_value_lines


def _lines(df: DataFrame, command: str, separator: str, key_fields: int) -> DataFrame:
    """One text column piped through ``command``, split into key and value."""
    spark = df.sparkSession
    view = f"pipe_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    quoted = command.replace("\\", "\\\\").replace("'", "\\'")
    fmt = "ROW FORMAT DELIMITED FIELDS TERMINATED BY '\\001' NULL DEFINED AS '\\\\N'"
    out = spark.sql(f"SELECT TRANSFORM(value) {fmt} USING '{quoted}' AS (line string) {fmt} FROM {view}")
    spark.catalog.dropTempView(view)  # the plan is made
    key, value = split_key_value(F.col("line"), separator, key_fields)
    return out.filter("line IS NOT NULL").select(key.alias("key"), value.alias("value"))


def pipe_map(df: DataFrame, command: str, separator: str = "\t", key_fields: int = 1) -> DataFrame:
    """Each partition's lines through a command; its lines as key and value."""
    return _lines(df.select(F.col(df.columns[-1]).cast("string").alias("value")), command, separator, key_fields)


def pipe_reduce(df: DataFrame, command: str, separator: str = "\t", key_fields: int = 1) -> DataFrame:
    """Lines ``key<sep>value`` sorted by key through a command, which finds the
    borders of the groups itself."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, "key").sortWithinPartitions("key", "value")
    return _lines(key_value_lines(dealt, separator=separator), command, separator, key_fields)


def pipe_job(df: DataFrame, mapper: str, reducer: str | None = None, combiner: str | None = None) -> DataFrame:
    """A map command, and optionally a combiner within partitions and a reducer."""
    mapped = pipe_map(df, mapper)
    if combiner:
        mapped = _lines(key_value_lines(mapped.sortWithinPartitions("key", "value")), combiner, "\t", 1)
    return pipe_reduce(mapped, reducer) if reducer else mapped


def pipe_pairs(df: DataFrame, command: str, schema: str) -> DataFrame:
    """Each partition's rows of two columns as typed bytes through a command, which
    writes typed bytes; its pairs as ``schema``.

    One thread feeds the command while its output is read, so neither is held whole.
    """
    from tarnflow.sources.arrow import arrow_schema
    from tarnflow.sources.typed_bytes import decode, encode

    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = subprocess.Popen(command, shell=True, stdin=subprocess.PIPE, stdout=subprocess.PIPE)

        def feed() -> None:
            with process.stdin as pipe:
                for batch in batches:
                    for key, value in zip(*(c.to_pylist() for c in batch.columns)):
                        pipe.write(encode(key) + encode(value))

        feeder = threading.Thread(target=feed)
        feeder.start()
        rows: list[tuple] = []
        while True:
            try:
                rows.append((decode(process.stdout), decode(process.stdout)))
            except EOFError:
                break
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
        feeder.join()
        if process.wait():
            raise RuntimeError(f"{command!r} ended with {process.returncode}")
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return df.mapInArrow(run, schema)
