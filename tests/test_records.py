import pytest
from pyspark.sql import types as T

from tarnflow.operators import diagnostics
from tarnflow.sources import records

TEXT = """
// a comment
module test.io {
  class Inner { int number; ustring name; }
  /* nested */
  class Outer { boolean flag; byte b; long l; float f; double d; buffer raw;
    vector<Inner> list; map<ustring, vector<long>> lookup; Inner one; }
}
"""


def test_definitions():
    found = records.parse_records(TEXT)
    outer = found["test.io.Outer"]
    assert [f.name for f in outer.fields] == ["flag", "b", "l", "f", "d", "raw", "list", "lookup", "one"]
    assert outer["list"].dataType == T.ArrayType(found["Inner"]) and outer["lookup"].dataType == T.MapType(T.StringType(), T.ArrayType(T.LongType()))
    for bad in ("class X { nope y; }", "class X { int y }", "what"):
        with pytest.raises(ValueError):
            records.parse_records(bad)


def test_round_trip_and_versions(spark, tmp_path):
    outer = records.parse_records(TEXT)["Outer"]
    row = (True, 1, 2, 1.5, 2.5, bytearray(b"\x00\x01"), [(1, "a"), (2, None)], {"k": [1, 2]}, (3, "c"))
    spark.createDataFrame([row], outer).write.parquet(f"{tmp_path}/r")
    back = spark.read.parquet(f"{tmp_path}/r")
    assert records.read_versioned(back, outer).first().asDict(recursive=True) == spark.createDataFrame([row], outer).first().asDict(recursive=True)
    newer = records.parse_records("class Inner { long number; int added; } class Outer { vector<Inner> list; ustring l; double gone; Inner one; vector<int> flag; }")["Outer"]
    got = records.read_versioned(back, newer).first().asDict(recursive=True)
    assert got == {"list": [{"number": 1, "added": None}, {"number": 2, "added": None}], "l": "2", "gone": None, "one": {"number": 3, "added": None}, "flag": None}


def test_job_diagnostics(spark):
    tasks = spark.createDataFrame([(1, 900, 50, 10), (2, 50, 25, 10), (3, 50, 25, 12)], "task int, n int, spilled int, output int")
    got = diagnostics.skew(tasks, "n").first()
    assert (got.tasks, got.busy) == (3, 1)
    assert diagnostics.spill_ratio(tasks, "spilled", "output").first()[0] == 100 / 32
    assert diagnostics.reexecution_ratio(tasks, "output", "task").first()[0] == (32 - 6) / 32
