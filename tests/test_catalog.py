"""Every registered query against its SQL on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tarnflow.plans import algorithms, catalog
from tarnflow.streaming import accumulate

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{float(value):.5f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    rows = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    expected = duck.sql(catalog.ORACLES[name])
    order = sorted(range(len(expected.columns)), key=lambda k: expected.columns[k])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows == sorted(tuple(plain(r[k]) for k in order) for r in expected.fetchall())


def test_imports_without_the_training_text_operators(tmp_path):
    """With their folders and the pipeline gone, the rest imports and lists its queries."""
    for part in ("tarnflow", "__spark_entry__.py", "bench.py"):
        source = os.path.join(ROOT, part)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / part)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split()[-2:] == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))]
    # the pipeline alone does not bring them back
    shutil.copy(os.path.join(ROOT, "bench.py"), tmp_path / "corpus_pipeline.py")
    subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_merged_batches(spark, tmp_path):
    """Counts merged batch by batch equal counts of all; a batch may run again."""
    for k in range(3):
        spark.createDataFrame([(f"a b{k}",), ("a",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    merged = accumulate.MergedTable(spark, ["word"], "cnt", lambda a, b: a + b)
    query = accumulate.keep_merged(accumulate.read_stream(spark, f"{tmp_path}/in/*", "text string"), merged, algorithms.wordcount)
    query.awaitTermination()
    assert {r.word: r.cnt for r in merged.read().collect()} == {"a": 6, "b0": 1, "b1": 1, "b2": 1}
    last = max(merged.versions)
    merged.update(spark.createDataFrame([("a", 1)], "word string, cnt long"), last + 1)
    merged.update(spark.createDataFrame([("a", 2)], "word string, cnt long"), last + 1)
    assert merged.read().filter("word = 'a'").first().cnt == 8
    # the folder is all there is to know
    again = accumulate.MergedTable(spark, ["word"], "cnt", lambda a, b: a + b, merged.folder)
    again.update(spark.createDataFrame([("a", 5)], "word string, cnt long"), last + 2)
    assert again.read().filter("word = 'a'").first().cnt == 13 and merged.versions[-1] == last + 2


def test_sessions_and_watermarks(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:03:00"), ("u", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "user string, at string").selectExpr("user", "cast(at AS timestamp) ts").coalesce(1).write.parquet(f"{tmp_path}/s")
    stream = accumulate.read_stream(spark, f"{tmp_path}/s", "user string, ts timestamp")
    out = accumulate.sessions(stream, "ts", "1 minute", "10 minutes", ["user"], F.count("*").alias("n")).select("n")
    out.writeStream.format("memory").queryName("sessions_test").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [r.n for r in spark.table("sessions_test").collect()] == [2]
