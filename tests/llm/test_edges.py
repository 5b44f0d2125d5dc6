"""Every query over odd tables: null in every column, empty and very long texts,
repeated rows, an empty table, and extra columns whose names clash."""

import pytest
from pyspark.sql import functions as F

from tarnflow.llm import queries

EXTRA = "score string, n_words string, kept string, component_id string, place string, part int, r string, batch string, ids string, word string, h string, x string, u string, id string, tokens string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LABELS = "doc_id long, quality int, toxic int, score string"


def rows():
    prose = "Plain words that follow each other here.\nAnd a second line of them too.\nThen a third one ends it."
    long_text = " ".join(f"word{k % 977} goes on" for k in range(30_000))
    filled = [(k, f"{prose} {k * 7919 % 101} {k}", "en", "web", 9) for k in range(40)]
    odd = [(100, None, None, None, None), (101, "", "en", "", 0), (102, " \n\t ", "en", "web", 1), (103, long_text, "en", "web", 1), (104, "x" * 50_000, None, "web", 1), (None, "no id here", "en", "web", 1), (None, None, None, None, None)]
    same = [(7, filled[7][1], "en", "web", 9), (7, filled[7][1], "en", "web", 9), (8, "another text of this id", "fr", None, None)]
    return [(*r, *["clash"] * 5, 1, *["clash"] * 9) for r in filled + odd + same]


def folder(spark, path, documents):
    spark.createDataFrame(documents, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k % 3 > 0), 0, "c") for k in range(30)] + [(None, 1, 0, None), (5, None, None, None), (9999, 1, 1, "c")]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("odd"), rows())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.fixture(scope="module")
def blank(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("blank"), [(None,) * len(SCHEMA.split(", "))] * 3)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    got = queries.QUERIES[name](spark, odd)
    found = [r.doc_id for r in got.collect()] if name != "op6_packing" else [r.doc_id for r in got.filter(F.col("start") == 0).collect()]
    assert sorted(found, key=str) == sorted((r[0] for r in rows()), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_and_blank_tables(spark, empty, blank, name):
    assert queries.QUERIES[name](spark, empty).count() == 0
    assert queries.QUERIES[name](spark, blank).count() == 3
