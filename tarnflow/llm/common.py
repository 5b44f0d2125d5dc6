"""What the operators share: reading, batches of bounded size, row mapping."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# batches go back to the system when they are read, not into a pool of the worker's
pa.set_memory_pool(pa.system_memory_pool())

#: Code points of text that one step of vectorised work takes at most, unless a
#: single text is longer.
BATCH_CHARS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def remainder(doc_id: int | None, divisor: int) -> int:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % divisor


def remainder_column(divisor: int, column: str = "doc_id"):
    """The same as a column."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in pieces, so that only few rows at a time are Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def parts(batch: pa.RecordBatch, most: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of the batch in pieces of at most ``most`` characters, or one text."""
    ids, texts, size = [], [], 0
    for piece in slices(batch):
        for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
            text = text or ""
            if texts and size + len(text) > most:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts


def map_texts(docs: DataFrame, work: Callable[[list, list[str]], dict[str, list]], schema: str, most: int = BATCH_CHARS) -> DataFrame:
    """One narrow pass: ``work`` gets lists of ids and texts and returns columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in parts(batch, most):
                yield to_batch(work(ids, texts), kinds)

    kinds = arrow_schema(docs.sparkSession, schema)
    return id_and_text(docs).mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def to_batch(columns: dict[str, list], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in kinds], schema=kinds)


def keep_rows(docs: DataFrame, verdicts: Callable[[list, list[str]], list[bool]], most: int = BATCH_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose verdict is true."""
    names = docs.columns
    at = names.index("doc_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([batch.column(at[0]), batch.column(at[1])], names=["doc_id", "text"])
            kept: list[bool] = []
            for ids, texts in parts(two, most):
                kept += verdicts(ids, texts)
            yield batch.filter(pa.array(kept, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def most_frequent(counts: DataFrame, column: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(the rows of highest count, all others): at most ``most`` rows of whole levels
    of the count's logarithm, found from one number for each level, so that no task
    and no driver sees more than that."""
    level = F.floor(F.log2(column) * 64)
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    total, cut = 0, None
    for row in sorted(rows, key=lambda r: -r["level"]):
        total += row["n"]
        if total > most:
            break
        cut = row["level"]
    if cut is None:
        return counts.filter(F.lit(False)), counts
    return counts.filter(level >= cut), counts.filter(level < cut)
