"""Queries over the parts of jobs: chains, partitioners, samplers, user-defined
pieces, iteration helpers, generators and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import fields, sketches
from tarnflow.functions.text import sparse_text, sparse_vector, tokens
from tarnflow.operators import aggregate, dataflow, diagnostics, index, join, sort
from tarnflow.operators.aggregate import Emit
from tarnflow.operators.pipe import pipe_job, pipe_map
from tarnflow.plans import algorithms, generators, incremental, iterate
from tarnflow.plans.queries_dataflow import WORDS
from tarnflow.plans.queries_graph import EDGE_CTE, part_edges
from tarnflow.plans.queries_incremental import CHOSEN
from tarnflow.plans.registry import register, table
from tarnflow.storage import materialize, scratch
from tarnflow.streaming import accumulate

# Maps, reduces, jobs


@register("SELECT o_orderpriority AS key, count(*) AS n, 'n=' || count(*) AS label FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def chain_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mappers, a reducer, and a mapper behind it, in one plan."""
    return dataflow.chain(
        table(spark, sf_dir, "orders"),
        lambda f: f.filter("o_orderstatus <> 'P'"),
        lambda f: f.select(F.col("o_orderpriority").alias("key")),
        lambda f: dataflow.reduce_by(f, ["key"], F.count("*").alias("n")),
        lambda f: f.withColumn("label", F.concat(F.lit("n="), "n")),
    )


@register("SELECT s_nationkey AS key, s_name AS value FROM supplier UNION ALL SELECT s_nationkey, s_name FROM supplier")
def identity_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity map and reduce: rows that repeat stay."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("value"))
    return dataflow.identity_reduce(rows.unionAll(rows))


@register(
    """SELECT (h % 2147483648) % 7 AS part, count(*) AS n FROM (
        SELECT list_reduce(list_prepend(1::BIGINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::BIGINT)), lambda h, b: (31 * h + b) % 4294967296) AS h FROM customer) GROUP BY 1"""
)
def hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the hash partition of their name."""
    return table(spark, sf_dir, "customer").groupBy(fields.hash_partition(F.col("c_name"), 7).alias("part")).agg(F.count("*").alias("n"))


@register("SELECT n_regionkey AS key, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def grouped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = dataflow.group_values(table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "key"), ["key"], F.col("n_name"))
    return grouped.select("key", F.array_join("values", ",").alias("names"))


@register("SELECT n_regionkey AS key, max(n_name) AS last FROM nation GROUP BY 1")
def opaque_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reducer that is any function over a whole group."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("key"), "n_name")
    return dataflow.reduce_groups(rows, ["key"], lambda g: g.groupby("key", as_index=False).agg(last=("n_name", "max")), "key int, last string")


@register("SELECT upper(n_name) AS name, n_nationkey FROM nation")
def threaded_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapper of several threads a task."""
    import pyarrow as pa

    def shout(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.upper() for x in batch.column(0).to_pylist()]), batch.column(1)], names=["name", "n_nationkey"])

    return dataflow.threaded_map(table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), shout, "name string, n_nationkey int")


@register("SELECT * FROM (VALUES ('count', 'SUCCESS'), ('fails', 'FAILED'), ('after both', 'DEPENDENT_FAILED'), ('after count', 'SUCCESS')) t(job, state)")
def job_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that wait for others; one that fails takes those behind it along."""
    orders = table(spark, sf_dir, "orders")

    def fails() -> None:
        raise RuntimeError("this job is meant to fail")

    jobs = [dataflow.Job("count", orders.count), dataflow.Job("fails", fails), dataflow.Job("after both", orders.count, ["count", "fails"]), dataflow.Job("after count", orders.distinct().count, ["count"])]
    return spark.createDataFrame(list(dataflow.run_jobs(jobs).items()), "job string, state string")


# Joins


@register("SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 10 = 1)")
def join_own_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation of the user's in a join expression: rows of the first table only."""
    def read(kind: str, path: str) -> DataFrame:
        frame = spark.read.format(kind).load(path)
        return frame.select(F.col("n_nationkey").alias("k"), "n_name") if "n_name" in frame.columns else frame.filter("s_suppkey % 10 = 1").select(F.col("s_nationkey").alias("k"))

    only = lambda sources, key: sources[0].join(sources[1].select(*key).distinct(), key, "left_anti")
    return join.join_expression(join.compose("only", "parquet", f"{sf_dir}/nation.parquet", f"{sf_dir}/supplier.parquet"), read, ["k"], join.OPERATIONS | {"only": only})


@register("SELECT n_nationkey AS k, min(s_name) AS value FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def join_multi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value of each joined row; keys without it go."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    first = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("s_name"))
    return join.multi_filter(join.outer_join([nations, first], ["k"]), ["k"], F.col("s1.s_name"))


@register("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_side_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table sent to every task, behind a check of its size."""
    side = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return join.side_join(table(spark, sf_dir, "customer"), side, ["c_nationkey"]).select("c_custkey", "n_name")


@register(
    """WITH c AS (SELECT c_nationkey AS k, c_name AS v FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) <= 2),
    s AS (SELECT s_nationkey AS k, s_name AS v FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) <= 2)
    SELECT c.k AS key, c.v || chr(9) || s.v AS joined FROM c JOIN s ON c.k = s.k"""
)
def join_tagged_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged join with at most two values of a source in a group."""
    sources = {"a": table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v")), "b": table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("v"))}
    return join.tagged_join(sources, "k", "v", most_values=2)


# Aggregates


@register("SELECT 'LongValueSum' AS type, 'record_count' AS id, CAST(count(*) AS VARCHAR) AS result FROM orders")
def record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.aggregate(table(spark, sf_dir, "orders"), [aggregate.record_count()])


@register("SELECT 'Product' AS type, n_regionkey || '' AS id, CAST(CAST(sum(n_nationkey * n_nationkey) AS BIGINT) AS VARCHAR) AS result FROM nation GROUP BY 2")
def plugin_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type of the user's: the sum of squares."""
    squares = lambda v: F.sum(v.cast("long") * v.cast("long"))
    return aggregate.aggregate(table(spark, sf_dir, "nation"), [Emit("Product", F.col("n_regionkey"), F.col("n_nationkey"))], plugins={"Product": squares})


@register(
    """SELECT 'LongValueSum' AS type, o_orderstatus AS id, CAST(count(*) AS VARCHAR) AS result FROM orders GROUP BY 2
    UNION ALL SELECT 'LongValueMax', o_orderstatus, CAST(max(o_custkey) AS VARCHAR) FROM orders GROUP BY 2
    UNION ALL SELECT 'UniqValueCount', o_orderstatus, CAST(count(DISTINCT o_orderpriority) AS VARCHAR) FROM orders GROUP BY 2"""
)
def aggregate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reducer of ``Type:id`` lines that an external mapper writes."""
    orders = table(spark, sf_dir, "orders").select(F.concat_ws(" ", "o_orderstatus", F.col("o_custkey").cast("string"), "o_orderpriority").alias("value"))
    script = r"sed -E 's/^([^ ]*) ?([^ ]*) ?(.*)$/LongValueSum:\1\t1\nLongValueMax:\1\t\2\nUniqValueCount:\1\t\3/'"
    lines = pipe_map(orders, script).select(F.concat_ws("\t", "key", "value").alias("value"))
    return aggregate.aggregate_lines(lines)


@register("SELECT l_returnflag, l_linenumber AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2")
def histogram_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.histogram_detail(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber")


@register(
    """SELECT r AS id, round(CASE WHEN u <= 0.1 THEN 1.0 WHEN u < 0.5 THEN 1 + (u - 0.1) * 2.5 WHEN u < 1.0 THEN 2 + (u - 0.5) * 16 ELSE 10.0 END, 6) AS value
    FROM (SELECT r, (r % 97) / 97.0 AS u FROM range(1000) t(r))"""
)
def cdf_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at cumulative probabilities, linear between points."""
    uniform = (F.col("id") % 97) / F.lit(97.0)
    return spark.range(1000).select("id", F.round(sketches.sample_cdf(uniform, [(1, 0.1), (2, 0.5), (10, 1.0)]), 6).alias("value"))


@register("SELECT CAST(sum(length(c_name)) AS BIGINT) * 10 AS estimate FROM customer")
def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output size of ten times the rows, estimated from these."""
    customers = table(spark, sf_dir, "customer")
    return aggregate.size_estimate(customers, F.col("c_name"), 10 * customers.count(), share=1.0)


@register(
    """WITH e AS (SELECT epoch_us(ts) // 60000000 AS b, value FROM events), m AS (SELECT max(b) AS now FROM e)
    SELECT round(sum(value), 2) AS since_start, round(sum(value) FILTER (b > now - 1440), 2) AS last_day, round(sum(value) FILTER (b > now - 60), 2) AS last_hour FROM e, m"""
)
def bucketed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving counters whose totals move on by buckets of a minute, updated in two goes."""
    events = table(spark, sf_dir, "events")
    first, second = (aggregate.bucket_totals(events.filter(F.col("event_id") % 2 == k), "ts", F.col("value"), 60) for k in (0, 1))
    merged = aggregate.merge_buckets(first, second)
    out = aggregate.bucketed_stats(merged, 60, {"last_day": 86400, "last_hour": 3600})
    return out.select(*(F.round(c, 2).alias(c) for c in out.columns))


@register("SELECT true AS no_loss, true AS few_more, true AS removed, true AS rows_hold_all")
def bloom_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting, retouched and dynamic filters keep their promises on the parts sold."""
    parts, sold = table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    bloom = sketches.Bloom()
    some = sold.filter("p_partkey % 3 = 0")
    left = bloom.delete(bloom.build(sold, "p_partkey"), some, "p_partkey")
    tested = bloom.test(sold, "p_partkey", left).select("p_partkey", "maybe")
    rows = sketches.dynamic_rows(sold, "p_partkey", 100)
    every = rows.groupBy("row_filter").agg(F.count("*").alias("n")).agg((F.sum("n") == sold.count()).alias("all"), (F.max("n") <= 100).alias("fits"))
    false = bloom.test(parts.join(sold, "p_partkey", "left_anti"), "p_partkey", bloom.build(sold, "p_partkey")).agg(F.count_if("maybe").alias("false"))
    kept = tested.agg(F.bool_and(F.col("maybe") | (F.col("p_partkey") % 3 == 0)).alias("no_loss"), (F.count_if((F.col("p_partkey") % 3 == 0) & F.col("maybe")) < 0.01 * F.count("*") + 1).alias("removed"))
    # one row each
    return kept.crossJoin(false).crossJoin(every).select("no_loss", (F.col("false") < 100).alias("few_more"), "removed", (F.col("all") & F.col("fits")).alias("rows_hold_all"))


# Order and partitions


def _breaks(df: DataFrame, *order: str) -> DataFrame:
    """How many rows of a sorted frame, and how many out of order, by partitions' own
    order and borders."""
    placed = materialize(df.select(F.struct(*order).alias("key")).withColumns({"file": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "sorted")
    breaks = sort.order_breaks(placed, "file", "place", "key").agg(F.count("*").alias("breaks"))
    return placed.agg(F.count("*").alias("n")).crossJoin(breaks)  # one row each


@register("SELECT count(*) AS n, 0::BIGINT AS breaks FROM orders")
def total_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows sorted over all partitions."""
    return _breaks(sort.total_order(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey")


@register("SELECT count(*) AS n, 0::BIGINT AS breaks FROM orders")
def column_sort_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines sorted by some of their columns."""
    lines = table(spark, sf_dir, "orders").select(F.concat_ws("\t", "o_orderpriority", F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.col("o_orderkey").cast("string")).alias("line"))
    parts = F.split("line", "\t")
    sorted_lines = sort.column_sort(lines, "line", [1, 0]).select(parts[1].alias("a"), parts[0].alias("b"), "line")
    return _breaks(sorted_lines, "a", "b", "line")


@register("SELECT count(DISTINCT o_orderpriority) AS keys, count(DISTINCT o_orderpriority) AS places FROM orders")
def key_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an equal part of their key are in one partition."""
    lines = table(spark, sf_dir, "orders").select(F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("line"))
    dealt = sort.key_partition(lines, "line", "-k2,2", 5).select(F.split("line", "\t")[1].alias("k"), F.spark_partition_id().alias("p"))
    return dealt.agg(F.count_distinct("k").alias("keys"), F.count_distinct("k", "p").alias("places"))


@register("SELECT count(DISTINCT substr(c_name, 10, 8)) AS keys, count(DISTINCT substr(c_name, 10, 8)) AS places FROM customer")
def binary_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with an equal range of bytes are in one partition."""
    rows = table(spark, sf_dir, "customer").withColumn("b", F.col("c_name").cast("binary"))
    dealt = sort.binary_partition(rows, "b", 6, 9, 16).select(F.substring("c_name", 10, 8).alias("k"), F.spark_partition_id().alias("p"))
    return dealt.agg(F.count_distinct("k").alias("keys"), F.count_distinct("k", "p").alias("places"))


@register("SELECT 'interval' AS kind, true AS good UNION ALL SELECT 'random', true UNION ALL SELECT 'split', true UNION ALL SELECT 'points', true")
def samplers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples see all partitions, and split points make ranges of like sizes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey").repartition(4, "o_orderkey")
    n = orders.count()
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    each = sort.interval_sample(orders, "o_orderkey", 10).count() == -(-n // 10)
    share = sort.random_sample(orders, 0.3, 5)
    some = 0.2 * n < share.count() < 0.4 * n and parts(share) == 4
    first = sort.split_sample(orders, 5)
    of_all = first.count() == 20 and parts(first) == 4
    sizes = [r["n"] for r in sort.range_partitions(orders, "o_orderkey", sort.split_points(orders, "o_orderkey", 4)).groupBy("partition").agg(F.count("*").alias("n")).collect()]
    alike = len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)
    return spark.createDataFrame([("interval", each), ("random", some), ("split", of_all), ("points", alike)], "kind string, good boolean")


# Iteration


@register("SELECT CAST(n_nationkey AS BIGINT) AS dk, n_name AS dv FROM nation")
def identity_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of the identity over a static key that is the state's key."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    job = iterate.IterativeJob(nations.select(F.col("k").alias("sk")), nations.select(F.col("k").alias("dk"), F.col("n_name").alias("dv")), iterate.identity_projector(), iterate.identity_step)
    return job.run(3).state


@register("SELECT CAST(c_custkey AS INTEGER) AS key, c_name AS value, c_acctbal AS state FROM customer")
def distributed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static and state text rows as co-partitioned tables, joined by key."""
    customers = table(spark, sf_dir, "customer")
    static, state = (customers.select(F.col("c_custkey").cast("string").alias("key"), F.col(c).cast("string").alias("value")) for c in ("c_name", "c_acctbal"))
    paths = iterate.distribute(static, state, 4, scratch(spark, "tables"))
    a, b = (spark.read.parquet(p) for p in paths)
    return a.join(b.withColumnRenamed("value", "state"), "key").select("key", "value", "state")


@register("SELECT 'static' AS name, count(*) AS n FROM customer UNION ALL SELECT 'state', count(*) FROM customer")
def dumped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text dump of a written container."""
    from tarnflow.sources import files, sinks

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))
    found = []
    for name in ("static", "state"):
        path = scratch(spark, name)
        sinks.write_sequence(rows, path)
        dump = sinks.key_value_lines(files.read_sequence_as_text(spark, path))
        found.append(dump.filter(F.instr("value", "\t") > 0).agg(F.lit(name).alias("name"), F.count("*").alias("n")))
    return found[0].union(found[1])


def matrix_sql(source: str) -> str:
    """Fixpoint of half a row-normalised matrix plus one, by unrolled steps."""
    parts = [f"mat AS MATERIALIZED (SELECT i, j, m FROM {source})", "v0 AS (SELECT DISTINCT i AS dk, 1.0::DOUBLE AS dv FROM cells)"]
    for k in range(36):
        parts.append(f"v{k + 1} AS MATERIALIZED (SELECT v0.dk, 1 + coalesce(s, 0) AS dv FROM v0 LEFT JOIN (SELECT i, sum(m * dv) AS s FROM mat JOIN v{k} ON j = dk GROUP BY 1) ON i = v0.dk)")
    return ", ".join(parts)


CELLS = "q AS (SELECT l_partkey % 97 AS i, l_suppkey % 97 AS j, sum(l_quantity) AS m FROM lineitem GROUP BY 1, 2), cells AS MATERIALIZED (SELECT i, j, 0.5 * m / sum(m) OVER (PARTITION BY i) AS m FROM q)"


@register(f"WITH {CELLS}, {matrix_sql('(SELECT i, j, CASE WHEN (i * 31 + j) % 10 = 0 THEN m / 2 ELSE m END AS m FROM cells)')} SELECT dk AS i, round(dv, 6) AS v FROM v36")
def incr_gimv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixpoint of a matrix iteration after a tenth of the entries changed."""
    quantities = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 97).alias("i"), (F.col("l_suppkey") % 97).alias("j")).agg(F.sum("l_quantity").alias("m"))
    rows = quantities.groupBy("i").agg(F.sum("m").alias("all"))
    matrix = materialize(quantities.join(rows, "i").select("i", "j", (F.lit(0.5) * F.col("m") / F.col("all")).alias("m")), "matrix")
    vector = matrix.select(F.col("i").alias("dk")).distinct().withColumn("dv", F.lit(1.0))
    old = iterate.IterativeJob(
        matrix.select(F.struct("i", "j").alias("sk"), "i", "j", "m"), vector, iterate.Projector(F.col("j"), iterate.Projection.ONE2MUL),
        lambda paired, state: vector.select("dk").join(paired.groupBy(F.col("i").alias("dk")).agg(F.sum(F.col("m") * F.col("dv")).alias("s")), "dk", "left").select("dk", (F.lit(1.0) + F.coalesce("s", F.lit(0.0))).alias("dv")),
    ).run(36, checkpoint_every=6).state
    ops = F.array(F.struct(F.col("m"), F.lit("-").alias("op")), F.struct((F.col("m") / 2).alias("m"), F.lit("+").alias("op")))
    delta = matrix.filter((F.col("i") * 31 + F.col("j")) % 10 == 0).select("i", "j", F.explode(ops).alias("o")).select("i", "j", "o.m", "o.op")
    after = incremental.incremental_gimv(matrix, old, delta, 1e-9)
    return after.select(F.col("dk").alias("i"), F.round("dv", 6).alias("v"))


@register("SELECT o_custkey AS k2, CAST(sum(CASE WHEN o_orderkey % 10 = 3 THEN o_custkey + 1 ELSE o_custkey END) AS BIGINT) AS total FROM orders GROUP BY 1")
def preserved_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map outputs kept in a folder by one run, opened and updated by another."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.struct("o_custkey", F.col("o_custkey").alias("v")).alias("value"))
    job = incremental.FineGrain(lambda rows: rows.select(F.col("value.o_custkey").alias("k2"), F.col("key").alias("sk"), F.col("value.v").alias("v2")), [F.sum("v2").alias("total")])
    folder = scratch(spark, "store")
    incremental.PreservedStore(spark, folder).save(*job.build(orders))
    store = incremental.PreservedStore(spark, folder)  # as a later run opens it
    new = F.struct(F.col("value.o_custkey").alias("o_custkey"), (F.col("value.v") + 1).alias("v"))
    delta = generators.update_delta(orders, "key", "value", new, F.col("key") % 10 == 3)
    store.save(*job.update(*store.load(), delta))
    return store.load()[1]


# Generators


@register(
    f"""WITH {EDGE_CTE}, a AS (SELECT src, string_agg(dst, ' ' ORDER BY dst) || ' ' AS links FROM edges GROUP BY 1), p AS (SELECT * FROM a WHERE {CHOSEN.format('src', 20)} OR (src % 100 = 0 AND src < 1000))
    SELECT src AS key, links AS value, '-' AS op FROM p UNION ALL SELECT src, links || ((src * 31 + 7) % 1000) || ' ', '+' FROM p WHERE NOT (src % 100 = 0 AND src < 1000)"""
)
def update_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta of link lists: a target more for some nodes, some nodes deleted."""
    return generators.update_links(algorithms.adjacency(part_edges(spark, sf_dir)), 1000, 20, delete=True)


@register(f"WITH {EDGE_CTE}, p AS (SELECT src, dst, w FROM edges WHERE {CHOSEN.format('(src * 31 + dst)', 30)}) SELECT src, dst, w, op FROM p, (VALUES ('-'), ('+')) t(op)")
def update_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta of weights; the random new ones are positive and written as the old."""
    delta = generators.update_weights(part_edges(spark, sf_dir), 30)
    old = part_edges(spark, sf_dir).select("src", "dst", "w").filter(generators.chosen(F.col("src") * 31 + F.col("dst"), 30))
    return delta.filter("op = '-'").unionByName(_as_old(delta, old))


def _as_old(delta: DataFrame, old: DataFrame) -> DataFrame:
    """The old weights once for each new, positive one of the same link."""
    new = delta.filter("op = '+' AND w > 0").groupBy("src", "dst").agg(F.count("*").alias("n"))
    counted = old.groupBy("src", "dst").agg(F.count("*").alias("m"))
    good = new.join(counted, ["src", "dst"]).filter("n = m").select("src", "dst")
    return old.join(good, ["src", "dst"], "left_semi").withColumn("op", F.lit("+"))


@register(f"SELECT i, j, CASE WHEN {CHOSEN.format('(i * 31 + j)', 25)} THEN -1.0 ELSE m END AS m, CASE WHEN {CHOSEN.format('(i * 31 + j)', 25)} THEN '+' END AS op FROM (SELECT l_partkey % 97 AS i, l_suppkey % 97 AS j, sum(l_quantity) AS m FROM lineitem GROUP BY 1, 2)")
def update_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with new values for some, shown as -1 where they are in range."""
    matrix = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 97).alias("i"), (F.col("l_suppkey") % 97).alias("j")).agg(F.sum("l_quantity").alias("m"))
    new = (F.col("op") == "+") & F.col("m").between(0, 1)
    return generators.update_matrix(matrix, 25).withColumn("m", F.when(new, F.lit(-1.0)).otherwise(F.col("m")))


@register(
    f"""SELECT 'changed' AS what, 2 * count(*) AS n FROM embeddings WHERE {CHOSEN.format('vec_id', 30)} AND NOT ({CHOSEN.format('(vec_id + 1)', 10)})
    UNION ALL SELECT 'deleted', count(*) FROM embeddings WHERE {CHOSEN.format('(vec_id + 1)', 10)}
    UNION ALL SELECT 'new', count(*) FROM embeddings WHERE {CHOSEN.format('(vec_id + 2)', 5)}"""
)
def update_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta of points: moved, deleted and new ones, counted."""
    rows = table(spark, sf_dir, "embeddings")
    points = rows.select(F.col("vec_id").alias("id"), F.map_from_arrays(F.sequence(F.lit(0), F.lit(3)), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))).alias("vector"))
    top = rows.agg(F.max("vec_id")).first()[0]
    gone = generators.chosen(F.col("key") + 1, 10) & (F.col("key") <= top)
    what = F.when(F.col("key") > top, "new").when(gone, "deleted").otherwise("changed")
    return generators.update_points(points, 30, 10, 5).groupBy(what.alias("what")).agg(F.count("*").alias("n"))


@register("SELECT 'points' AS what, 500 AS n, true AS good UNION ALL SELECT 'vector', 300, true UNION ALL SELECT 'factors', 200, true UNION ALL SELECT 'pairs', 400, true UNION ALL SELECT 'power', 250, true")
def generated_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated points, matrix, factors and pairs are what they should be."""
    points = generators.generate_points(spark, 500, 100, 10).select("id", F.explode("vector").alias("d", "v"))
    entries, vector = generators.generate_matrix(spark, 300, 5)
    factors = generators.generate_factors(spark, 200, 8).select("i", F.explode("values").alias("v"))
    links = generators.generate_links(spark, 250)
    frames = {
        "points": points.agg(F.count_distinct("id").alias("n"), F.bool_and(F.col("v").between(1, 500) & F.col("d").between(0, 99)).alias("good")),
        "vector": vector.join(entries.select(F.col("i").alias("dk")).distinct(), "dk").agg(F.count("*").alias("n"), F.bool_and(F.col("dv") == 0.001).alias("good")),
        "factors": factors.agg(F.count_distinct("i").alias("n"), F.bool_and((F.col("v") >= 0) & (F.col("v") < 1)).alias("good")),
        "pairs": generators.random_pairs(spark, 400).agg(F.count_distinct("key").alias("n"), F.bool_and((F.length("key") == 10) & (F.length("value") == 20)).alias("good")),
        "power": links.agg(F.count_distinct("src").alias("n"), F.bool_and(F.col("dst").between(0, 249)).alias("good")),
    }
    return dataflow.by_source([(f, lambda f, name=name: f.select(F.lit(name).alias("what"), F.col("n").cast("int").alias("n"), "good")) for name, f in frames.items()])


@register(f"WITH {EDGE_CTE} SELECT src, string_agg(dst, ' ' ORDER BY dst) || ' ' AS links FROM edges GROUP BY 1")
def format_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link lines as numbers, gathered into link lists."""
    lines = part_edges(spark, sf_dir).select(F.concat(F.lit("  "), "src", F.lit(" \t"), "dst").alias("value"))
    return algorithms.adjacency(algorithms.format_graph(lines))


@register("SELECT round(sum(o_totalprice), 0) AS total FROM orders")
def sum_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("string").alias("value"))
    return generators.sum_lines(lines.unionByName(spark.createDataFrame([("no number",)], "value string"))).withColumn("total", F.round("total", 0))


@register("SELECT vec_id AS id, CAST(0 AS INTEGER) AS dim, round(CAST(embedding[1] AS DOUBLE), 5) AS x FROM embeddings UNION ALL SELECT vec_id, 1, round(CAST(embedding[2] AS DOUBLE), 5) FROM embeddings")
def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as ``dim,val`` text and back."""
    pairs = F.map_from_arrays(F.array(F.lit(0), F.lit(1)), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")))
    text = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sparse_text(pairs).alias("text"))
    return text.select("id", F.explode(sparse_vector(F.col("text"))).alias("dim", "x")).withColumn("x", F.round("x", 5))


@register("SELECT conv_id, turn, text FROM conversations")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text field of JSON lines."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("line"))
    return lines.select("conv_id", "turn", algorithms.json_text(F.col("line")).alias("text"))


# Processes, index, streams, diagnostics


@register(f"SELECT word AS key, count(*) AS cnt FROM ({WORDS.replace('text', 'lower(n_name)').replace('documents', 'nation')}) GROUP BY 1")
def pipe_combiner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An external mapper, a combiner that counts, and a reducer that adds counts."""
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("value"))
    add = "awk -F '\\t' '{n[$1] += ($2 == \"\" ? 1 : $2)} END {for (k in n) print k \"\\t\" n[k]}'"
    piped = pipe_job(names, "tr -s ' ' '\\n'", add, add)
    return piped.select("key", F.col("value").cast("long").alias("cnt"))


@register("SELECT n_name AS key, n_regionkey AS value FROM nation")
def pipe_typed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs through a command that reads and writes typed bytes."""
    from tarnflow.operators.pipe import pipe_pairs

    return pipe_pairs(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), "cat", "key string, value int")


@register(
    """SELECT doc_id || '' AS doc_id, CASE WHEN quality = 0 THEN 'delete' WHEN toxic = 1 THEN 'update' ELSE 'insert' END AS op,
        CASE WHEN quality = 0 THEN '' WHEN toxic = 1 THEN 'some new text' ELSE 'plain text' END AS text FROM labels"""
)
def index_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation lines of an index."""
    word = F.when(F.col("quality") == 0, " Delete").when(F.col("toxic") == 1, " UPD some new text").otherwise(" plain text")
    lines = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), word).alias("value"))
    return index.parse_operations(lines)


@register("SELECT count(*) FILTER (quality = 0) * 4 + count(*) FILTER (quality <> 0 AND toxic = 1) * 5 AS rows, count(*) FILTER (quality <> 0 AND toxic = 1) AS inserts, 4 AS shards FROM labels")
def index_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations routed round robin: deletes go to all shards, inserts to one."""
    op = F.when(F.col("quality") == 0, "delete").when(F.col("toxic") == 1, "update")
    operations = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), op.alias("op"), F.lit("t").alias("text")).filter("op IS NOT NULL")
    return index.route_operations(operations, 4, round_robin=True).agg(F.count("*").alias("rows"), F.count_if(F.col("op") == "insert").alias("inserts"), F.count_distinct(F.when(F.col("op") == "delete", F.col("shard"))).cast("int").alias("shards"))


@register(
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events with less than six hours between them."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = accumulate.sessions(events, "ts", "1 minute", "6 hours", ["user_id"], F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("stop"), "n")


@register("SELECT round(sum(l_partkey) / sum(l_suppkey), 6) AS spill_ratio FROM lineitem")
def spill_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.spill_ratio(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey").withColumn("spill_ratio", F.round("spill_ratio", 6))


@register("SELECT round((sum(l_partkey) - sum(l_suppkey)) / sum(l_partkey), 6) AS reexecuted FROM lineitem")
def reexecution_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.reexecution_ratio(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey").withColumn("reexecuted", F.round("reexecuted", 6))


@register(f"SELECT word, count(*) AS cnt FROM ({WORDS.replace('documents', 'benchmark')}) WHERE word <> '' GROUP BY word")
def stream_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of a stream, as its last whole result."""
    stream = accumulate.read_stream(spark, f"{sf_dir}/benchmark.parquet*", "item_id long, text string")
    return accumulate.keep_latest(accumulate.running_wordcount(stream))


@register(f"SELECT count(*) AS words, max(length(word)) AS longest FROM (SELECT DISTINCT word FROM ({WORDS.replace('documents', 'conversations')}) WHERE word <> '')")
def token_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return words.agg(F.count("*").alias("words"), F.max(F.length("word").cast("long")).alias("longest"))
