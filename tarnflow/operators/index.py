"""Inverted index with inserts, deletes and updates of documents over shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.text import tokens


def parse_operations(lines: DataFrame, column: str = "value") -> DataFrame:
    """``id op text`` lines as ``doc_id, op, text``; without a known operation the
    line is an insert of everything after the id."""
    parts = F.split(column, " ", 3)
    word = F.lower(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    op = F.when(word.isin("i", "ins", "insert"), "insert").when(word.isin("d", "del", "delete"), "delete").when(word.isin("u", "upd", "update"), "update")
    rest = F.coalesce(F.get(F.split(column, " ", 2), F.lit(1)), F.lit(""))
    return lines.select(parts[0].alias("doc_id"), F.coalesce(op, F.lit("insert")).alias("op"), F.when(op.isNull(), rest).otherwise(F.coalesce(F.get(parts, F.lit(2)), F.lit(""))).alias("text"))


def latest_operation(operations: DataFrame, order: str) -> DataFrame:
    """The last operation of each document."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(order)))
    return operations.withColumn("__place", place).filter("__place = 1").drop("__place")


def apply_operations(documents: DataFrame, operations: DataFrame, order: str) -> DataFrame:
    """Documents after all operations: deleted ones go, others get the last text."""
    last = latest_operation(operations, order)
    kept = documents.select("doc_id", "text").join(last, "doc_id", "left_anti")
    return kept.unionByName(last.filter("op <> 'delete'").select("doc_id", "text"))


def postings(documents: DataFrame) -> DataFrame:
    """``term, doc_id, tf``: one row for each term of each document, which is the
    form that scales; terms in very many documents stay many rows."""
    terms = documents.select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def inverted_index(documents: DataFrame) -> DataFrame:
    """``term, df, cf, first_doc, last_doc`` of all postings."""
    return postings(documents).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def update_postings(old: DataFrame, operations: DataFrame, order: str) -> DataFrame:
    """Postings after the operations: those of touched documents are replaced."""
    last = latest_operation(operations, order)
    kept = old.join(last.select("doc_id"), "doc_id", "left_anti").select("term", "doc_id", "tf")
    return kept.unionByName(postings(last.filter("op <> 'delete'")))


def shard_of(doc_id: str, shards: int):
    """Hash of the id: the same shard for an insert and a later delete."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(shards))


def route_operations(operations: DataFrame, shards: int, round_robin: bool = False) -> DataFrame:
    """Operations with their ``shard``. Under round robin the old shard is unknown:
    deletes (and the delete half of updates) go to all shards."""
    if not round_robin:
        return operations.withColumn("shard", shard_of("doc_id", shards))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    adds = operations.filter("op <> 'delete'").withColumn("op", F.lit("insert")).withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    return operations.filter("op <> 'insert'").withColumn("op", F.lit("delete")).withColumn("shard", F.explode(every.cast("array<long>"))).unionByName(adds)
