import datetime as dt
from decimal import Decimal
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from tarnflow.sources import database, files, global_state, sinks, typed_bytes


@pytest.mark.parametrize(
    "splits, low, high, expected",
    [(10, 0, 100, list(range(0, 101, 10))), (10, 0, 95, [*range(0, 91, 9), 95]), (1, 5, 5, [5, 5]), (5, 5, 5, [5, 5]), (5, 3, 5, [3, 4, 5])],
)
def test_integer_points(splits, low, high, expected):
    assert database.integer_points(splits, low, high) == expected


@pytest.mark.parametrize("word, expected", [("", ""), ("A", "A"), ("Z", "Z"), ("abc", "abc"), ("big str", "big str"), ("AVeryLongStringIndeed", "AVeryLon")])
def test_text_numbers(word, expected):
    assert database.number_text(database.text_number(word)) == expected


def test_text_points():
    assert database.text_points(25, "A", "Z") == [chr(c) for c in range(ord("A"), ord("Z") + 1)]
    points = database.text_points(4, "Hand", "Hardy")
    assert points[0] == "Hand" and points[-1] == "Hardy" and points == sorted(points) and all(p.startswith("Ha") for p in points)


VALUES = [
    [1, 2, 3, 50, 99, None],
    [None, None],
    [0.5, 2.25, 7.0],
    ["apple", "ape", "zebra", "", None, "it's"],
    [True, False, None],
    [Decimal("1.10"), Decimal("9.90"), Decimal("5.00")],
    [dt.datetime(2010, 4, 1), dt.datetime(2010, 4, 2), dt.datetime(2010, 5, 1), dt.datetime(2011, 4, 1)],
    [dt.date(2010, 4, 1), dt.date(2011, 4, 1), dt.date(2010, 4, 9)],
]


@pytest.mark.parametrize("values", VALUES, ids=str)
def test_every_row_is_read_once(spark, values):
    kind = next((k for t, k in ((bool, "boolean"), (int, "long"), (float, "double"), (str, "string"), (Decimal, "decimal(10,2)"), (dt.datetime, "timestamp_ntz"), (dt.date, "date")) if any(isinstance(v, t) for v in values)), "long")
    frame = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    for splits in (1, 3, 10):
        predicates = database.scan_predicates(frame, "v", splits)
        got = [r.v for r in database.read_split(frame, predicates).collect()]
        assert sorted(got, key=str) == sorted(values, key=str), predicates


def test_queries():
    assert database.page_query("t", ["a", "b"], "a > 1", "a", 10, 20) == "SELECT a, b FROM t AS t WHERE (a > 1) ORDER BY a LIMIT 10 OFFSET 20"
    assert "ROWNUM" in database.page_query("t", ["a"], limit=5, dialect="rownum")
    assert database.with_conditions("SELECT * FROM t WHERE $CONDITIONS", "a < 3") == "SELECT * FROM t WHERE (a < 3)"
    with pytest.raises(ValueError):
        database.with_conditions("SELECT 1", "a < 3")
    assert "TO_TIMESTAMP('2010-04-01 00:00:00'" in database.oracle_dates("c >= '2010-04-01 00:00:00'")


def test_text_files(spark, tmp_path):
    frame = spark.createDataFrame([("a", "1"), (None, "2"), ("c", None), (None, None), ("7", "1.5")], "key string, value string")
    sinks.write_key_value(frame, f"{tmp_path}/kv")
    got = {tuple(r) for r in files.read_key_value(spark, f"{tmp_path}/kv").collect()}
    assert got == {("a", "1"), ("2", ""), ("c", ""), ("7", "1.5")}
    floats = {r.key: r.value for r in files.read_int_key_value(spark, f"{tmp_path}/kv", "double").collect()}
    assert floats[7] == 1.5 and floats[files.MAX_INT] == files.MAX_FLOAT
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_key_value(frame, f"{tmp_path}/kv")
    sinks.write_key_value(frame, f"{tmp_path}/gz", compression="gzip")
    assert files.read_key_value(spark, f"{tmp_path}/gz").count() == 4


def test_numbered_lines(spark, tmp_path):
    for name, n in (("a", 25), ("b", 7)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k}\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        rows = files.read_n_lines(spark, str(tmp_path), 10).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 32
    assert all(r.value == f"{r.value[0]}{r.line}" and r.chunk == r.line // 10 for r in rows)


def test_containers_and_detection(spark, tmp_path):
    frame = spark.createDataFrame([("k1", "v1"), ("k2", "v2")], "key string, value string")
    sinks.write_sequence(frame, f"{tmp_path}/seq")
    sinks.write_key_value(frame, f"{tmp_path}/text")
    for path in ("seq", "text"):
        assert {tuple(r) for r in files.read_any(spark, f"{tmp_path}/{path}").collect()} == {("k1", "v1"), ("k2", "v2")}
    assert files.read_sequence_as_text(spark, f"{tmp_path}/seq").dtypes == [("key", "string"), ("value", "string")]
    both = files.read_inputs(spark, [(f"{tmp_path}/seq", files.read_sequence, lambda f: f), (f"{tmp_path}/text", files.read_key_value, lambda f: f.withColumn("tag", F.lit("text")))])
    assert both.count() == 4 and both.filter("tag IS NULL").count() == 2


def test_xml_and_tera(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<a>\n<r>one\n</r><r>two</r></a>")
    assert [r.value for r in files.read_xml(spark, str(tmp_path), "<r>", "</r>").collect()] == ["<r>one\n</r>", "<r>two</r>"]
    rows = spark.createDataFrame([("abcdefghij", "value1")], "key string, value string")
    sinks.write_tera(rows, f"{tmp_path}/tera")
    got = files.read_tera(spark, f"{tmp_path}/tera").first()
    assert (got.key, got.value.strip()) == ("abcdefghij", "value1")


def test_map_file_and_side_outputs(spark, tmp_path):
    frame = spark.range(100).withColumn("v", F.col("id") * 2)
    sinks.write_map_file(frame, f"{tmp_path}/map", "id", 4)
    assert sinks.lookup(spark, f"{tmp_path}/map", "id", 42).first().v == 84
    sinks.write_by(frame, f"{tmp_path}/by", F.concat(F.lit("m"), F.col("id") % 3))
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["name=m0", "name=m1", "name=m2"]
    sinks.write_named(frame, {"low": (F.col("id") < 5, f"{tmp_path}/low"), "none": (F.col("id") < 0, f"{tmp_path}/none")})
    assert spark.read.parquet(f"{tmp_path}/low").count() == 5 and not (tmp_path / "none").exists()
    sinks.discard(frame)


def test_filters(spark):
    import hashlib

    frame = spark.range(95).select(F.col("id").cast("string").alias("key"), "id")
    assert sorted(r.id for r in files.filter_percent(frame, ["id"], 10).collect()) == list(range(0, 95, 10))
    assert {r.key for r in files.filter_regex(frame, "key", "[1-3]").collect()} == {"1", "2", "3"}
    expected = {str(k) for k in range(95) if int.from_bytes(hashlib.md5(str(k).encode()).digest()[:8], "big", signed=True) % 10 == 0}
    assert {r.key for r in files.filter_md5(frame, "key", 10).collect()} == expected


def test_global_state(spark, tmp_path):
    state = spark.createDataFrame([("1", "a:b"), ("2", "")], "id string, record string")
    sinks.write_global(state, f"{tmp_path}/g")
    assert {tuple(r) for r in global_state.read_global(spark, f"{tmp_path}/g").collect()} == {("1", "a:b"), ("2", "")}
    with pytest.raises(Exception, match="duplicate id 1"):
        global_state.merge_global(state, state.limit(1)).collect()


def test_typed_bytes(spark, tmp_path):
    values = [True, 5, 1 << 40, -2.5, "größe", b"\x00\xff", ("a", 1), [1, [2]], {"k": (1.5, None and 0 or "z")}]
    for value in values:
        assert typed_bytes.decode(BytesIO(typed_bytes.encode(value))) == value
    with pytest.raises(TypeError):
        typed_bytes.encode(object())
    rows = [("a", [1, 2]), ("b", [])]
    frame = spark.createDataFrame(rows, "key string, value array<long>").coalesce(1)
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "x.tb").write_bytes(b"".join(bytes(r.content) for r in typed_bytes.encode_pairs(frame).collect()))
    got = typed_bytes.read_typed_bytes(spark, f"{tmp_path}/data", "key string, value array<long>")
    assert [(r.key, r.value) for r in got.collect()] == rows


def test_offsets_and_xml_over_small_splits(spark, tmp_path):
    """Places and records do not depend on where files are split."""
    text = "".join(f"<r>{'é' * (k % 7)}{k}\n</r>{'-' * (k % 5)}" for k in range(60)) + "<r>not ended"
    lines = [f"line {k} {'ü' * (k % 9)}" for k in range(80)]
    (tmp_path / "x").mkdir()
    (tmp_path / "t").mkdir()
    (tmp_path / "x" / "a.xml").write_text(text)
    (tmp_path / "t" / "a.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        found = sorted(r.value for r in files.read_xml(spark, f"{tmp_path}/x", "<r>", "</r>").collect())
        rows = files.read_records_with_offsets(spark, f"{tmp_path}/t").collect()
        short = files.read_records_with_offsets(spark, f"{tmp_path}/t", most_bytes=10).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == sorted(f"<r>{'é' * (k % 7)}{k}\n</r>" for k in range(60))
    raw = "\n".join(lines).encode()
    assert len(rows) == 80 and all(raw[r.offset : r.offset + len(r.value.encode())].decode() == r.value for r in rows)
    assert [r.value for r in rows if not r.ended] == [lines[-1]]
    assert short == sum(len(x.encode()) <= 10 for x in lines)


def test_own_queries_of_databases():
    assert database.page_query("t", ["a"], None, "a", 10, 20, "fetch") == "SELECT a FROM t AS t ORDER BY a OFFSET 20 ROWS FETCH NEXT 10 ROWS ONLY"
