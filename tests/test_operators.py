import pytest
from pyspark.sql import functions as F

from tarnflow.functions import sketches
from tarnflow.operators import aggregate, dataflow, index, join, pipe, sort
from tarnflow.operators.aggregate import Emit


def test_typed_aggregates(spark):
    """Line i holds the number i, i times."""
    words = spark.createDataFrame([(f"{i:04d}",) for i in range(1, 20) for _ in range(i)], "w string")
    w = F.col("w")
    emits = [Emit("LongValueSum", F.concat(F.lit("count_"), w), F.lit(1)), Emit("LongValueMax", F.lit("max"), w), Emit("LongValueMin", F.lit("min"), w), Emit("StringValueMax", F.lit("smax"), w.cast("int").cast("string")), Emit("StringValueMin", F.lit("smin"), w.cast("int").cast("string")), Emit("UniqValueCount", F.lit("uniq"), w), Emit("DoubleValueSum", F.lit("dsum"), F.lit("0.5")), Emit("ValueHistogram", F.lit("hist"), w)]
    got = {(r.type, r.id): r.result for r in aggregate.aggregate(words, emits, most_unique=14).collect()}
    assert all(got["LongValueSum", f"count_{i:04d}"] == str(i) for i in range(1, 20))
    assert got["LongValueMax", "max"] == "19" and got["LongValueMin", "min"] == "1"
    assert got["StringValueMax", "smax"] == "9" and got["StringValueMin", "smin"] == "1"
    assert got["UniqValueCount", "uniq"] == "15" and got["DoubleValueSum", "dsum"] == "95.0"
    n, least, median, most, mean, deviation = got["ValueHistogram", "hist"].split("\t")
    assert (n, least, median, most, float(mean)) == ("19", "1", "10", "19", 10.0) and float(deviation) == pytest.approx(30**0.5)
    with pytest.raises(ValueError):
        aggregate.aggregate(words, [Emit("Other", w, w)])


def test_tagged_join(spark):
    """Four sources; every fourth key is shared, and each source repeats one row."""
    sources = {}
    for i in range(4):
        rows = [(16 * (k // 4) if k % 4 == 0 else k * 4 + i, 10 * k + i) for k in range(9)]
        rows = [(k * 4 if k % 4 == 0 else k * 4 + i, 10 * k + i) for k in range(9)]
        sources[chr(97 + i)] = spark.createDataFrame([*rows, rows[i]], "k long, v long")
    out = join.tagged_join(sources, "k", "v").collect()
    assert len(out) == 4
    for row in out:
        values = list(map(int, row.joined.split("\t")))
        assert row.key % 16 == 0 and [(v - i) * 4 for i, v in enumerate(values)] == [10 * row.key] * 4


def test_join_operations(spark):
    a = spark.createDataFrame([(1, "a1"), (1, "a1b"), (2, "a2")], "k int, v string")
    b = spark.createDataFrame([(1, "b1"), (3, "b3")], "k int, v string")
    frames = {"a": a, "b": b}
    run = lambda e: join.join_expression(e, lambda kind, path: frames[path], ["k"])
    assert {(r.k, r.s0.v, r.s1.v) for r in run('inner(tbl(x,"a"),tbl(x,"b"))').collect()} == {(1, "a1", "b1"), (1, "a1b", "b1")}
    outer = {(r.k, r.s0 and r.s0.v, r.s1 and r.s1.v) for r in run(join.compose("outer", "x", "a", "b")).collect()}
    assert outer == {(1, "a1", "b1"), (1, "a1b", "b1"), (2, "a2", None), (3, None, "b3")}
    assert {(r.k, r.v) for r in run('override(tbl(x,"a"),tbl(x,"b"))').collect()} == {(1, "b1"), (2, "a2"), (3, "b3")}
    assert {(r.k, r.v) for r in run('override(tbl(x,"a"),tbl(x,"a"))').collect()} == {(1, "a1"), (1, "a1b"), (2, "a2")}
    for bad in ("nope(tbl(x,a))", "inner(tbl(x,a)", "inner(tbl(x,a)) x"):
        with pytest.raises(ValueError):
            run(bad)
    assert join.multi_filter(join.outer_join([a, b], ["k"]), ["k"], F.col("s1.v")).count() == 3
    assert join.side_join(a, b.withColumnRenamed("v", "w"), ["k"]).count() == 3


def test_order_checks(spark):
    rows = [("f1", 1, 5), ("f1", 2, 7), ("f1", 3, 6), ("f2", 1, 4), ("f2", 2, 9)]
    got = {tuple(r) for r in sort.order_breaks(spark.createDataFrame(rows, "f string, p int, k int"), "f", "p", "k").collect()}
    assert got == {("record", "f1", 6, 7), ("file", "f2", 4, 6)}


def test_samples_and_points(spark):
    frame = spark.range(1000)
    points = sort.split_points(frame, "id", 4)
    assert points == [250, 500, 750]
    assert sorted(r.id for r in sort.interval_sample(frame, "id", 300).collect()) == [0, 300, 600, 900]
    placed = sketches.running_total(frame.withColumn("one", F.lit(2)), "id", "one").collect()
    assert all(r.running == 2 * (r.id + 1) for r in placed)


def test_jobs():
    seen = []
    job = lambda name, *after, fail=False: dataflow.Job(name, lambda: 1 / 0 if fail else seen.append(name), list(after))
    state = dataflow.run_jobs([job("c", "a", "b"), job("a"), job("b", "a"), job("x", fail=True), job("y", "x"), job("z", "y", "a")])
    assert state == {"a": "SUCCESS", "b": "SUCCESS", "c": "SUCCESS", "x": "FAILED", "y": "DEPENDENT_FAILED", "z": "DEPENDENT_FAILED"}
    assert seen.index("a") < seen.index("b") < seen.index("c")
    with pytest.raises(ValueError):
        dataflow.run_jobs([job("a", "b"), job("b", "a")])
    with pytest.raises(ValueError):
        dataflow.run_jobs([job("a", "missing")])


def test_counters_and_bad_records(spark):
    frame = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    counters = dataflow.Counters(rows=F.lit(1), bad=F.col("v").try_cast("int").isNull() & F.col("v").isNotNull())
    assert counters.watch(frame).count() == 3
    assert counters.values == {"rows": 3, "bad": 1}
    good, bad = dataflow.skip_bad(frame, n=(F.col("v"), "int"))
    assert {r.n for r in good.collect()} == {1, None} and [r.v for r in bad.collect()] == ["x"]


def test_pipes(spark):
    lines = spark.createDataFrame([("roses are red",), ("violets are blue",), ("bunnies are pink",)], "value string")
    out = {r.key.strip() for r in pipe.pipe_job(lines, "tr ' ' '\\n'", "uniq -c").collect()}
    assert {" ".join(x.split()) for x in out} == {"3 are", "1 blue", "1 bunnies", "1 pink", "1 red", "1 roses", "1 violets"}


def test_bloom_kinds(spark):
    bloom = sketches.Bloom(size=1 << 12, hashes=3)
    a, b = spark.range(0, 60).toDF("x"), spark.range(40, 100).toDF("x")
    fa, fb = bloom.build(a, "x"), bloom.build(b, "x")
    found = lambda f, df: df.count() == bloom.test(df, "x", f).filter("maybe").count()
    assert found(fa, a) and found(bloom.union(fa, fb), spark.range(100).toDF("x")) and found(bloom.intersection(fa, fb), spark.range(40, 60).toDF("x"))
    rest = bloom.delete(bloom.build(spark.range(100).toDF("x"), "x"), a, "x")
    assert found(rest, spark.range(60, 100).toDF("x")) and bloom.test(a, "x", rest).filter("maybe").count() < 10
    assert bloom.complement(fa).count() + fa.count() == 1 << 12
    assert bloom.exclusive(fa, fa).count() == 0
    wrong = spark.range(5).toDF("x")
    assert bloom.test(wrong, "x", bloom.retouch(fa, wrong, "x")).filter("maybe").count() == 0
    assert sketches.dynamic_rows(spark.range(100).toDF("x"), "x", 4, 8).groupBy("row_filter").count().agg(F.max("count")).first()[0] <= 4


def test_cdf_sampling(spark):
    points = [(0.0, 0.0), (10.0, 0.5), (20.0, 1.0)]
    frame = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.75,), (1.0,)], "u double")
    assert [r[0] for r in frame.select(sketches.sample_cdf(F.col("u"), points)).collect()] == [0.0, 5.0, 10.0, 15.0, 20.0]


def test_index_operations(spark):
    lines = spark.createDataFrame([("d1 ins red rose", 1), ("d2 plain text here", 2), ("d1 upd blue", 3), ("d3 i x y", 4), ("d3 del", 5)], "value string, seq int")
    ops = index.parse_operations(lines.select("value")).collect()
    assert {tuple(r) for r in ops} == {("d1", "insert", "red rose"), ("d2", "insert", "plain text here"), ("d1", "update", "blue"), ("d3", "insert", "x y"), ("d3", "delete", "")}
    parsed = index.parse_operations(lines.select("value", "seq")).withColumn("seq", F.monotonically_increasing_id())
    old = spark.createDataFrame([("d1", "red rose"), ("d3", "x y"), ("d9", "kept")], "doc_id string, text string")
    after = index.apply_operations(old, parsed, "seq")
    direct = {tuple(r) for r in index.postings(after).collect()}
    assert direct == {tuple(r) for r in index.update_postings(index.postings(old), parsed, "seq").collect()}
    assert {r.doc_id for r in after.collect()} == {"d1", "d2", "d9"}
    assert index.route_operations(parsed, 3).select("shard").distinct().count() <= 3
    assert index.route_operations(parsed, 3, round_robin=True).filter("op = 'delete'").count() == 6


def test_pipe_pairs_fails_with_its_command(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").coalesce(1)
    assert sorted(map(tuple, pipe.pipe_pairs(frame, "cat", "k string, v int").collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="ended with 3"):
        pipe.pipe_pairs(frame, "cat > /dev/null; exit 3", "k string, v int").collect()


def test_aggregate_lines_of_another_form(spark):
    lines = spark.createDataFrame([("LongValueSum:a:b\t2",), ("LongValueSum:a:b\t3",), ("ValueHistogram:h\tx",)], "value string")
    assert {(r.type, r.id): r.result.split("\t")[0] for r in aggregate.aggregate_lines(lines).collect()} == {("LongValueSum", "a:b"): "5", ("ValueHistogram", "h"): "1"}
    with pytest.raises(Exception, match="not an aggregate"):
        aggregate.aggregate_lines(spark.createDataFrame([("Nope:a\t1",)], "value string")).collect()


def test_buckets_are_merged(spark):
    rows = spark.createDataFrame([(f"2024-01-01 00:0{k}:30", k) for k in range(10)], "t string, v int").withColumn("t", F.col("t").cast("timestamp"))
    parts = [aggregate.bucket_totals(rows.filter(F.col("v") % 3 == k), "t", F.col("v"), 60) for k in range(3)]
    out = aggregate.bucketed_stats(aggregate.merge_buckets(*parts), 60, {"last_three": 180, "last": 60}).first()
    assert tuple(out) == (45, 24, 9)


def test_inner_join_deals_large_products_to_many_tasks(spark):
    names = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, n string")
    a = spark.range(90).selectExpr("cast(if(id < 80, 1, 2) as int) k", "id a").unionByName(spark.createDataFrame([(None, 5)], "k int, a long"))
    b = spark.range(200).selectExpr("cast(if(id < 150, 1, 2) as int) k", "id b").unionByName(spark.createDataFrame([(None, 5), (3, 6)], "k int, b long"))
    plain, dealt = join.inner_join([names, a, b], ["k"]), join.inner_join([names, a, b], ["k"], most=500)
    assert dealt.columns == plain.columns and dealt.count() == 80 * 150 + 10 * 50
    assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()
    swapped = join.inner_join([names, b, a], ["k"], most=500)
    assert swapped.selectExpr("k", "s0", "s2 s1", "s1 s2").exceptAll(plain).isEmpty() and swapped.count() == plain.count()
    tasks = [r["count"] for r in dealt.filter("k = 1").groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 1 and max(tasks) < 80 * 150 * 0.8


def test_aggregate_lines_are_read_once(spark):
    """Lines of a process come from one run of it, whatever their types."""
    runs = spark.sparkContext.accumulator(0)

    def lines(batches):
        runs.add(1)
        yield from batches

    rows = spark.createDataFrame([("LongValueSum:a\t2",), ("LongValueSum:a\t3",), ("UniqValueCount:a\tx",), ("UniqValueCount:a\tx",), ("UniqValueCount:a\ty",), ("ValueHistogram:h\tx",), ("DoubleValueSum:d\t0.5",), ("StringValueMin:a\tq",)], "value string")
    got = aggregate.aggregate_lines(rows.coalesce(1).mapInArrow(lines, "value string"))
    found = {(r.type, r.id): r.result.split("\t")[0] for r in got.collect()}
    assert found == {("LongValueSum", "a"): "5", ("UniqValueCount", "a"): "2", ("ValueHistogram", "h"): "1", ("DoubleValueSum", "d"): "0.5", ("StringValueMin", "a"): "q"}
    assert runs.value == 1
