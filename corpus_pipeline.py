"""The corpus pipeline: five operators over the table ``documents``, in order.

Each stage takes ``(spark, docs, sf_dir)``, works on everything that the stage
before it kept, and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of
``documents`` (and any others that came in, whatever their names); a cut text gets
its new ``n_chars``.

Defined cases of all stages: an empty table stays empty; null values in columns
other than ``doc_id`` and ``text`` pass through; texts of any length are worked on
whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import jaccard_join, language_id, line_dedup, packing, quality_rules
from tarnflow.storage import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; those without letters or with a low posterior go.

    Null and empty texts have no letter and go; rows without ``lang`` teach nothing
    and are judged like all others, and so are null and repeated ids; where no row has
    a ``lang`` every document goes. Of equal posteriors the first language by name counts.
    """
    return language_id.keep_identified(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the compression bands that pass the base rules.

    Every row is judged by its own text, so repeated rows and null ids get one verdict;
    null, empty and very short texts fail the base rules and go.
    """
    return quality_rules.keep_quality(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of lines; a document that loses all its words goes.

    The document of the smallest id keeps a passage, null ids come last, and rows that
    repeat id and text are one document and are cut alike; null texts stay null.
    """
    cut = line_dedup.deduplicate(docs, drop_emptied=True)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The smallest id of a group stays, with one row, whatever rows repeat it; rows
    without id belong to no group and stay, and so do texts without words, one row an id.
    """
    return jaccard_join.keep_one_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens.

    A null or empty text is the end id alone; repeated rows and null ids are packed as
    documents of their own; pieces of one size are placed in order of id and start.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard", keep_one_of_similar),
    ("packing", pack_sequences),
]

#: Trained models, compression and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
