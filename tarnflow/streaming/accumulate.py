"""Streams: running counts, event-time windows, and results kept up to date by batch.

The accumulator of incremental batches is a streaming aggregate, or, where the old
result is a table, a merge of each micro-batch's aggregate into it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnflow.functions.text import tokens
from tarnflow.storage import exists, numbered_folders, scratch


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they come, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def running_wordcount(stream: DataFrame, column: str = "text") -> DataFrame:
    """Counts of all words so far; for update or complete mode."""
    return stream.select(F.explode(tokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def windowed(stream: DataFrame, time: str, late: str, size: str, slide: str | None, group: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by event-time window; a window is final when the watermark, the
    latest time less ``late``, has passed its end."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window, *group).agg(*aggregates)


def sessions(stream: DataFrame, time: str, late: str, gap: str, group: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by session: rows of a group with less than ``gap`` between them."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *group).agg(*aggregates)


class MergedTable:
    """A result table that each micro-batch's aggregate is merged into.

    Versions are written side by side, named by batch number, so a batch that is run
    again after a failure replaces its own version. The folder is all the state there
    is: opened again after a restart, with the stream's checkpoint in it, work goes on.
    """

    def __init__(self, spark: SparkSession, key: list[str], value: str, merge: Callable[[Column, Column], Column], folder: str | None = None) -> None:
        self.spark, self.key, self.value, self.merge = spark, key, value, merge
        self.folder = folder or scratch(spark, "merged")

    @property
    def versions(self) -> list[int]:
        """Batches whose version is complete, in order."""
        return [n for n in numbered_folders(self.spark, self.folder) if exists(self.spark, f"{self.folder}/{n}/_SUCCESS")]

    def update(self, batch: DataFrame, number: int) -> None:
        from tarnflow.plans.incremental import accumulate

        earlier = [n for n in self.versions if n < number]
        out = batch if not earlier else accumulate(self.read(max(earlier)), batch, self.key, self.merge, value=self.value)
        out.write.mode("overwrite").parquet(f"{self.folder}/{number}")

    def read(self, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{max(self.versions) if number is None else number}")


def keep_latest(rows: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream of whole results over all that is there, and read the last one, which
    is written like every other, not gathered."""
    spark = rows.sparkSession
    folder = scratch(spark, "latest")
    query = rows.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/{number}")).outputMode(mode)
    query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/{max(numbered_folders(spark, folder))}")


def keep_merged(stream: DataFrame, table: MergedTable, aggregate: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Start merging the aggregate of every micro-batch; stops when all is read."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: table.update(aggregate(batch), number))
        .option("checkpointLocation", f"{table.folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
