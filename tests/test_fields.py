import pytest
from pyspark.sql import functions as F

from tarnflow.functions import fields, text
from tarnflow.operators import sort


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "line string")


def test_field_lists():
    assert fields.parse_field_list("8,2-4,0") == fields.FieldList((8, 2, 3, 4, 0))
    assert fields.parse_field_list("-1,7-") == fields.FieldList((0, 1), 7)
    assert fields.parse_selection(":3,1-")[0].empty


def test_selection_of_map_and_reduce(spark):
    """Five named fields through both halves of a selection job."""
    frame = lines(spark, *("/".join(f"{name}{i}" for name in ("red", "green", "blue", "grey", "white")) for i in range(6)))
    key, value = fields.select_key_value(F.col("line"), "3,0-1:2-", "/")
    mapped = frame.select(F.concat_ws("/", key, value).alias("line"))
    out = mapped.select(fields.select_fields(F.col("line"), fields.parse_selection(":5,0,2-3")[1], "/").alias("line")).collect()
    # grey red green | blue grey white, of which the sixth, the first, the third and the fourth
    assert sorted(r.line for r in out) == [f"white{i}/grey{i}/green{i}/blue{i}" for i in range(6)]


def test_fields_that_are_not_there(spark):
    key, value = fields.select_key_value(F.col("line"), "9,0:1,7,2-", ",")
    rows = lines(spark, "a,b,c", "a", "a,b,,").select(key, value).collect()
    assert [tuple(r) for r in rows] == [(",a", "b,,c"), (",a", ","), (",a", "b,")]
    key, value = fields.select_key_value(F.col("line"), ":0", ",")
    assert tuple(lines(spark, "a,b").select(key, value).first()) == ("a", "")


ROWS = ["7 -30 b002x 5.25", "31 -4 a010y 5.3", "7 12 b001z -0.5", "200 -4 a9 5.250"]


def plain_key(line, spec):
    """Keys of the specs below, written out by hand."""
    f = line.split(" ")
    return {
        "-k1,1": (f[0],), "-k1,1n": (float(f[0]),), "-k2,2nr": (-float(f[1]),), "-k3.2,3.4n": (float("".join(c for c in f[2][1:4] if c.isdigit()) or 0),),
        "-k4,4n -k1,1n": (float(f[3]), float(f[0])), "-k3,3r": tuple(-ord(c) for c in f[2]), "-n -k2,2": (float(f[1]),), "-k4.1,4.1": (f[3][0],),
    }[spec]


@pytest.mark.parametrize("spec", ["-k1,1", "-k1,1n", "-k2,2nr", "-k3.2,3.4n", "-k4,4n -k1,1n", "-k3,3r", "-n -k2,2", "-k4.1,4.1"])
def test_key_specs(spark, spec):
    out = [r.line for r in lines(spark, *ROWS).coalesce(1).orderBy(*fields.sort_columns(F.col("line"), spec, " "), "line").collect()]
    assert out == sorted(ROWS, key=lambda line: (plain_key(line, spec), line))


def test_bad_specs():
    for spec in ("-k", "-kx", "-z", "k1"):
        with pytest.raises((ValueError, IndexError)):
            fields.parse_sort_spec(spec)


def test_total_order_probes(spark):
    points = ["cedar", "elm", "oak", "pine", "yew"]
    words = ["ash", "cedar", "cedars", "dogwood", "elm", "elmo", "maple", "oak", "oaks", "pine", "spruce", "yew", "zelkova", ""]
    out = sort.range_partitions(lines(spark, *words), "line", points).collect()
    assert {r.line: r.partition for r in out} == {w: sum(p <= w for p in points) for w in words}
    with pytest.raises(ValueError):
        sort.range_partitions(lines(spark, "a"), "line", ["b", "a"])


def test_key_value_lines(spark):
    key, value = text.split_key_value(F.col("line"))
    got = lines(spark, "one\ttwo\t", "\tno key", "no separator", "a\tb\tc", "").select(key, value).collect()
    assert [tuple(r) for r in got] == [("one", "two\t"), ("", "no key"), ("no separator", ""), ("a", "b\tc"), ("", "")]
    key, value = text.split_key_value(F.col("line"), ";", 2)
    assert [tuple(r) for r in lines(spark, "p;q;r;s", "p;q", "p").select(key, value).collect()] == [("p;q", "r;s"), ("p;q", ""), ("p", "")]


def test_hash_partition(spark):
    def plain(word, parts):
        h = 1
        for b in word.encode():
            h = (31 * h + (b - 256 if b > 127 else b)) % 2**32
        return h % 2**31 % parts

    words = ["", "a", "abc", "größe", "日本", "x" * 200]
    got = {r.line: r.p for r in lines(spark, *words).select("line", fields.hash_partition(F.col("line"), 13).alias("p")).collect()}
    assert got == {w: plain(w, 13) for w in words}


def test_byte_range(spark):
    frame = spark.createDataFrame([(bytearray(b"abcdef"),)], "b binary")
    for left, right, expected in ((0, -1, b"abcdef"), (1, 2, b"bc"), (-3, -2, b"de"), (2, 99, b"cdef"), (4, 2, b"")):
        assert bytes(frame.select(fields.byte_range(F.col("b"), left, right)).first()[0]) == expected


def test_sparse_vectors(spark):
    frame = lines(spark, "3,1.5 0,2.0 ")
    vector = text.sparse_vector(F.col("line"))
    assert frame.select(vector).first()[0] == {3: 1.5, 0: 2.0}
    assert frame.select(text.sparse_text(vector)).first()[0] == "0,2.0 3,1.5 "
