"""Queries over dataflow operators: text, aggregates, joins, order, scans, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import sketches
from tarnflow.functions.fields import select_key_value, sort_columns
from tarnflow.functions.text import line_per_match, matches, split_key_value, tokens
from tarnflow.operators import aggregate, dataflow, diagnostics, index, join, sort
from tarnflow.operators.aggregate import Emit
from tarnflow.operators.pipe import pipe_job
from tarnflow.plans import algorithms, generators
from tarnflow.plans.registry import register, table
from tarnflow.sources import database, files, global_state
from tarnflow.streaming import accumulate

WORDS = r"""SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents"""


@register(f"SELECT word, count(*) AS cnt FROM ({WORDS}) WHERE word <> '' GROUP BY word")
def wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.wordcount(table(spark, sf_dir, "documents"))


@register(f"SELECT 'LongValueSum' AS type, word AS id, CAST(count(*) AS VARCHAR) AS result FROM ({WORDS}) WHERE word <> '' GROUP BY word")
def agg_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word"))
    return aggregate.aggregate(words, [Emit("LongValueSum", F.col("word"), F.lit(1))])


@register(
    f"""WITH c AS (SELECT word, count(*) AS c FROM ({WORDS}) WHERE word <> '' GROUP BY word)
    SELECT count(*) AS n, min(c) AS least, list_sort(list(c))[count(*) // 2 + 1] AS median, max(c) AS most,
           round(avg(c), 6) AS mean, round(stddev_pop(c), 4) AS deviation FROM c"""
)
def word_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word"))
    return aggregate.value_histogram(words, [], "word").withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 4))


@register(
    r"""SELECT match, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '[a-z]*tion')) AS match FROM documents) GROUP BY match"""
)
def grep_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.grep(table(spark, sf_dir, "documents"), "text", "[a-z]*tion")


@register(
    r"""SELECT line, count(*) AS cnt FROM (
          SELECT line, unnest(regexp_extract_all(line, 'ing')) FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY line"""
)
def logalyzer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return sort.count_descending(line_per_match(lines, "line", "ing"), "line")


@register("SELECT unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS value FROM pages")
def xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.explode(matches(F.col("html"), "(?s)<p>(.*?)</p>", 1)).alias("value"))


@register(
    """SELECT CASE WHEN instr(p_name, ' ') = 0 THEN p_name ELSE substr(p_name, 1, instr(p_name, ' ') - 1) END AS key,
              CASE WHEN instr(p_name, ' ') = 0 THEN '' ELSE substr(p_name, instr(p_name, ' ') + 1) END AS value FROM part"""
)
def key_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, value = split_key_value(F.col("p_name"), " ")
    return table(spark, sf_dir, "part").select(key.alias("key"), value.alias("value"))


@register("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS record FROM region")
def global_state_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("record"))
    return global_state.parse_global(global_state.format_global(global_state.merge_global(state)))


# Aggregates


@register("SELECT l_returnflag, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def long_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_partkey").alias("total"))


@register("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1, 2")
def double_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat("l_returnflag", "l_linestatus")
    out = aggregate.aggregate(table(spark, sf_dir, "lineitem"), [Emit("DoubleValueSum", group, F.col("l_extendedprice"))])
    return out.select(F.left("id", F.lit(1)).alias("l_returnflag"), F.right("id", F.lit(1)).alias("l_linestatus"), F.round(F.col("result").cast("double"), 2).alias("total"))


@register("SELECT o_orderpriority, max(o_custkey) AS most FROM orders GROUP BY 1")
def long_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max("o_custkey").alias("most"))


@register("SELECT o_orderpriority, min(o_custkey) AS least FROM orders GROUP BY 1")
def long_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.min("o_custkey").alias("least"))


@register("SELECT c_mktsegment, max(c_name) AS most FROM customer GROUP BY 1")
def string_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.max("c_name").alias("most"))


@register("SELECT c_mktsegment, min(c_name) AS least FROM customer GROUP BY 1")
def string_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_name").alias("least"))


@register("SELECT l_returnflag, count(DISTINCT l_partkey) AS uniq FROM lineitem GROUP BY 1")
def uniq_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.unique_count(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey")


@register("SELECT l_suppkey, least(count(DISTINCT l_partkey), 15) AS uniq FROM lineitem GROUP BY 1")
def uniq_count_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of an aggregate that counts up to 14 values and one more."""
    return aggregate.unique_count(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey", 14)


@register(
    """WITH c AS (SELECT l_returnflag, l_suppkey, count(*) AS c FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, count(*) AS n, min(c) AS least, list_sort(list(c))[count(*) // 2 + 1] AS median, max(c) AS most,
           round(avg(c), 6) AS mean, round(stddev_pop(c), 4) AS deviation FROM c GROUP BY 1"""
)
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.value_histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_suppkey")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 4))


@register(
    """WITH c AS (SELECT l_partkey AS v, count(*) AS n FROM lineitem GROUP BY 1),
    r AS (SELECT v, sum(n) OVER (ORDER BY v) AS running FROM c), t AS (SELECT sum(n) AS total FROM c)
    SELECT CAST(b AS BIGINT) AS bucket, min(v) AS value FROM r, t, (SELECT unnest([5, 25, 50, 75, 95]) AS b) WHERE running >= b * total // 100 GROUP BY b
    UNION ALL SELECT 0, min(v) FROM c UNION ALL SELECT 100, max(v) FROM c"""
)
def cdf_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.cdf_quantiles(table(spark, sf_dir, "lineitem"), "l_partkey", 100, [5, 25, 50, 75, 95])


@register(
    """SELECT 'LongValueSum' AS type, o_orderstatus AS id, CAST(count(*) AS VARCHAR) AS result FROM orders GROUP BY 2
    UNION ALL SELECT 'LongValueMax', o_orderpriority, CAST(max(o_custkey) AS VARCHAR) FROM orders GROUP BY 2
    UNION ALL SELECT 'StringValueMin', o_orderstatus, min(o_orderpriority) FROM orders GROUP BY 2
    UNION ALL SELECT 'UniqValueCount', 'all', CAST(count(DISTINCT o_custkey) AS VARCHAR) FROM orders"""
)
def typed_multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority, customer = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey")
    emits = [Emit("LongValueSum", status, F.lit(1)), Emit("LongValueMax", priority, customer), Emit("StringValueMin", status, priority), Emit("UniqValueCount", F.lit("all"), customer)]
    return aggregate.aggregate(table(spark, sf_dir, "orders"), emits)


@register(
    """SELECT o_orderstatus, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(var_samp(o_totalprice) / 1000, 0) AS variance,
           round(stddev_samp(o_totalprice), 2) AS deviation, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1"""
)
def running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.sample_stat(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice")
    return out.withColumns({"mean": F.round("mean", 4), "variance": F.round(F.col("variance") / 1000, 0), "deviation": F.round("deviation", 2)})


@register(
    """WITH n AS (SELECT max(ts) AS now FROM events)
    SELECT round(sum(value), 2) AS since_start, round(sum(value) FILTER (ts > now - INTERVAL 7 DAY), 2) AS last_week, round(sum(value) FILTER (ts > now - INTERVAL 1 DAY), 2) AS last_day,
           round(sum(value) FILTER (ts > now - INTERVAL 1 HOUR), 2) AS last_hour, round(sum(value) FILTER (ts > now - INTERVAL 1 MINUTE), 2) AS last_minute FROM events, n"""
)
def moving_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = {"last_week": "7 DAY", "last_day": "1 DAY", "last_hour": "1 HOUR", "last_minute": "1 MINUTE"}
    out = aggregate.moving_stats(table(spark, sf_dir, "events"), "ts", F.col("value"), spans)
    return out.select(*(F.round(c, 2).alias(c) for c in out.columns))


@register("SELECT n AS members, n AS found FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem)")
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Bloom filter of the parts sold finds each of them."""
    sold = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    bloom = sketches.Bloom()
    tested = bloom.test(sold, "l_partkey", bloom.build(sold, "l_partkey"))
    return tested.agg(F.count("*").alias("members"), F.count_if("maybe").alias("found"))


@register("SELECT url, views, sum(views) OVER () = total AS verified FROM (SELECT event_type AS url, count(*) AS views FROM events GROUP BY 1), (SELECT count(*) AS total FROM events)")
def db_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of each address, and whether they add up to the accesses."""
    accesses = table(spark, sf_dir, "events").select(F.col("event_type").alias("url"))
    views = accesses.groupBy("url").agg(F.count("*").alias("views"))
    total = views.agg(F.sum("views").alias("seen")).crossJoin(accesses.agg(F.count("*").alias("total")))  # one row each
    return views.crossJoin(F.broadcast(total)).select("url", "views", (F.col("seen") == F.col("total")).alias("verified"))


@register(
    f"""SELECT word, count(*) AS cnt FROM ({WORDS} UNION ALL {WORDS.replace('documents', 'benchmark')} UNION ALL {WORDS.replace('documents', 'conversations')}) WHERE word <> '' GROUP BY word"""
)
def multi_source_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of several inputs, read side by side."""
    frames = [(table(spark, sf_dir, name), lambda f: f.select("text")) for name in ("documents", "benchmark", "conversations")]
    return algorithms.wordcount(dataflow.by_source(frames))


# Fields and maps


@register("SELECT n_regionkey || '-' || n_nationkey AS key, n_name || '-' || n_regionkey AS value FROM nation")
def field_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("-", F.regexp_replace("n_name", "-", "_"), "n_nationkey", "n_regionkey")
    key, value = select_key_value(line, "2,1:0,2-", "-")
    return table(spark, sf_dir, "nation").select(key.alias("key"), value.alias("value"))


@register("SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def inverse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    return dataflow.inverse(pairs)


@register(
    """SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(floor(c_acctbal) AS BIGINT) DESC, c_mktsegment, c_custkey) AS place FROM customer"""
)
def key_spec_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumn("line", F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_mktsegment", F.floor("c_acctbal").cast("string")))
    return sort.ranked(customers, ["c_nationkey"], sort_columns(F.col("line"), "-k3nr,3 -k2,2 -k1n,1")).select("c_nationkey", "c_custkey", "place")


@register("SELECT count(*) FILTER (try_cast(p_brand AS INTEGER) IS NULL AND p_brand IS NOT NULL) AS bad, count(*) FILTER (try_cast(p_brand AS INTEGER) IS NOT NULL) AS good FROM part")
def skip_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = dataflow.skip_bad(table(spark, sf_dir, "part"), brand=(F.col("p_brand"), "int"))
    return bad.agg(F.count("*").alias("bad")).crossJoin(good.filter("brand IS NOT NULL").agg(F.count("*").alias("good")))  # one row each


@register(f"SELECT word AS key, count(*) AS cnt FROM ({WORDS.replace('text', 'lower(n_name)').replace('documents', 'nation')}) GROUP BY 1")
def pipe_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("value"))
    piped = pipe_job(names, "tr -s ' ' '\\n'", "uniq -c")
    counted = F.split(F.trim("key"), " +")
    return piped.select(counted[1].alias("key"), counted[0].cast("long").alias("cnt"))


# Joins


@register(
    """SELECT n_nationkey AS k, n_name, s_name, c_name FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey"""
)
def join_inner_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.inner_join(_by_nation(spark, sf_dir), ["k"], most=4_000_000).select("k", "s0.n_name", "s1.s_name", "s2.c_name")


def _by_nation(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name"),
        table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_name"),
        table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_name"),
    ]


@register(
    """SELECT coalesce(a.k, b.k, c.k) AS k, CAST(a.v AS VARCHAR) AS first_finished, CAST(b.v AS VARCHAR) AS first_pending, c.v AS name
    FROM (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
    FULL JOIN (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.k = b.k
    FULL JOIN (SELECT c_custkey AS k, c_name AS v FROM customer) c ON coalesce(a.k, b.k) = c.k"""
)
def join_outer_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    first = [orders.filter(F.col("o_orderstatus") == s).groupBy("k").agg(F.min("o_orderkey").alias("v")) for s in "FP"]
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return join.outer_join([*first, names], ["k"]).select("k", F.col("s0.v").cast("string").alias("first_finished"), F.col("s1.v").cast("string").alias("first_pending"), F.col("s2.v").alias("name"))


@register(
    """WITH u AS (SELECT 0 AS s, CAST(c_custkey AS BIGINT) AS k, c_name AS v FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier UNION ALL SELECT 2, n_nationkey, n_name FROM nation)
    SELECT k, v FROM u QUALIFY rank() OVER (PARTITION BY k ORDER BY s DESC) = 1"""
)
def join_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.override_join(_numbered(spark, sf_dir)[:3], ["k"])


def _numbered(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    parts = (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))
    return [table(spark, sf_dir, t).select(F.col(k).cast("long").alias("k"), F.col(v).alias("v")) for t, k, v in parts]


@register(
    """SELECT coalesce(a.k, b.k, c.k, d.k) AS key, concat_ws(chr(9), a.v, b.v, c.v, d.v) AS joined
    FROM (SELECT c_custkey AS k, c_name AS v FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_name AS v FROM supplier) b ON a.k = b.k
    FULL JOIN (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation) c ON coalesce(a.k, b.k) = c.k
    FULL JOIN (SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS v FROM region) d ON coalesce(a.k, b.k, c.k) = d.k
    WHERE (a.k IS NOT NULL)::INT + (b.k IS NOT NULL)::INT + (c.k IS NOT NULL)::INT + (d.k IS NOT NULL)::INT >= 2"""
)
def join_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.tagged_join(dict(zip("abcd", _numbered(spark, sf_dir))), "k", "v")


@register("SELECT k, v FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) SEMI JOIN supplier ON s_nationkey = k")
def join_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with a supplier, by an expression: the override of the suppliers'
    nations by the nations themselves, joined with the suppliers' nations."""
    def read(kind: str, path: str) -> DataFrame:
        frame = spark.read.format(kind).load(path)
        if "n_name" in frame.columns:
            return frame.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
        return frame.select(F.col("s_nationkey").alias("k"), F.lit("none").alias("v")).distinct()

    nations, suppliers = f'tbl(parquet,"{sf_dir}/nation.parquet")', f'tbl(parquet,"{sf_dir}/supplier.parquet")'
    return join.join_expression(f"inner(override({suppliers},{nations}),{suppliers})", read, ["k"]).select("k", "s0.v")


# Order


@register("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def secondary_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return sort.ranked(orders, ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "place")


@register("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def total_order_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey").withColumn("one", F.lit(1))
    return sketches.running_total(orders, "o_orderkey", "one").select("o_orderkey", F.col("running").alias("place"))


@register("SELECT p, count(*) AS n FROM (SELECT CASE WHEN c_name < 'Customer#000000100' THEN 0 WHEN c_name < 'Customer#000000500' THEN 1 WHEN c_name < 'Customer#000001000' THEN 2 ELSE 3 END AS p FROM customer) GROUP BY 1")
def total_order_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ["Customer#000000100", "Customer#000000500", "Customer#000001000"]
    return sort.range_partitions(table(spark, sf_dir, "customer"), "c_name", points).groupBy(F.col("partition").alias("p")).agg(F.count("*").alias("n"))


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.col("o_orderkey"))


@register("SELECT l_partkey, count(*) AS cnt FROM lineitem GROUP BY 1")
def desc_count_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort.count_descending(table(spark, sf_dir, "lineitem"), "l_partkey")


@register(
    """WITH r AS (SELECT event_type AS file, user_id AS key, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events),
    e AS (SELECT event_type AS file, arg_min(user_id, event_id) AS key, arg_max(user_id, event_id) AS last FROM events GROUP BY 1),
    f AS (SELECT file, key, lag(last) OVER (ORDER BY file) AS before FROM e)
    SELECT 'record' AS kind, file, key, before FROM r WHERE key < before UNION ALL SELECT 'file', file, key, before FROM f WHERE key < before"""
)
def order_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort.order_breaks(table(spark, sf_dir, "events"), "event_type", "event_id", "user_id")


@register("SELECT 20000 AS n, 0 AS breaks, 20000 AS distinct_keys")
def tera_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows, sorted in range partitions, and checked by the partitions'
    own order and borders."""
    from tarnflow.storage import materialize

    rows = generators.tera_rows(spark, 20000)
    placed = materialize(rows.repartitionByRange(8, "key", "value").sortWithinPartitions("key", "value").withColumn("file", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "tera")
    breaks = sort.order_breaks(placed, "file", "place", "key").agg(F.count("*").cast("int").alias("breaks"))
    return placed.agg(F.count("*").cast("int").alias("n"), F.count_distinct("key").cast("int").alias("distinct_keys")).crossJoin(breaks).select("n", "breaks", "distinct_keys")  # one row each


# Record filters and scans


@register("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE (r - 1) % 10 = 0")
def sample_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.filter_percent(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 10)


@register(
    """SELECT c_custkey FROM (SELECT c_custkey, CAST('0x' || substr(md5(c_name), 1, 16) AS UBIGINT) AS u FROM customer)
    WHERE CASE WHEN u >= 9223372036854775808 THEN u % 10 = 6 ELSE u % 10 = 0 END"""
)
def sample_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.filter_md5(table(spark, sf_dir, "customer"), "c_name", 10).select("c_custkey")


@register("SELECT c_custkey FROM customer WHERE regexp_full_match(c_name, 'Customer#0*[1-9]7')")
def sample_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.filter_regex(table(spark, sf_dir, "customer"), "c_name", "Customer#0*[1-9]7").select("c_custkey")


@register(
    """WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, greatest((max(o_orderkey) - min(o_orderkey)) // 8, 1) AS step FROM orders)
    SELECT least((o_orderkey - lo) // step, -((lo - hi) // step) - CASE WHEN (hi - lo) % step = 0 THEN 1 ELSE 0 END) AS split, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total
    FROM orders, b GROUP BY 1"""
)
def db_scan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split of a scan by ranges of the order key."""
    orders = table(spark, sf_dir, "orders")
    split = F.lit(None).cast("long")
    for k, predicate in reversed(list(enumerate(database.scan_predicates(orders, "o_orderkey", 8)))):
        split = F.when(F.expr(predicate), F.lit(k).cast("long")).otherwise(split)
    return orders.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


# Sets, index, diagnostics


@register("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT s_nationkey, s_name FROM supplier")
def union_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.by_source([(frame, lambda f: f.toDF("k", "v")) for frame in _by_nation(spark, sf_dir)[:2]])


@register("SELECT DISTINCT s_nationkey AS k FROM supplier")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()


@register("SELECT n_nationkey AS k FROM nation EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier, _ = _by_nation(spark, sf_dir)
    return nation.select("k").exceptAll(supplier.select("k"))


@register("SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier, _ = _by_nation(spark, sf_dir)
    return nation.select("k").intersect(supplier.select("k"))


POSTINGS = r"""SELECT word AS term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM {}) WHERE word <> '' GROUP BY ALL"""


@register(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM ({POSTINGS.format('documents')}) GROUP BY 1")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.inverted_index(table(spark, sf_dir, "documents"))


@register(
    f"""WITH d AS (SELECT doc_id, text FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 0)),
    n AS (SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) THEN 'toxic' ELSE text END AS text FROM d)
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM ({POSTINGS.format('n')}) GROUP BY 1"""
)
def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after documents of bad quality are deleted and the text of toxic
    ones is replaced."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    operations = labels.select("doc_id", F.when(F.col("quality") == 0, "delete").when(F.col("toxic") == 1, "update").alias("op"), F.lit("toxic").alias("text"), F.lit(1).alias("seq")).filter("op IS NOT NULL")
    after = index.update_postings(index.postings(documents), operations, "seq")
    return after.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@register(
    """WITH t AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT n, coalesce(sum(n) OVER (ORDER BY n DESC, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM t)
    SELECT count(*) AS tasks, count(*) FILTER (before < total * 0.9) AS busy, round(count(*) FILTER (before < total * 0.9) / count(*), 6) AS busy_share FROM r"""
)
def job_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("task")).agg(F.count("*").alias("n"))
    return diagnostics.skew(tasks, "n").withColumn("busy_share", F.round("busy_share", 6))


# Streams


@register(f"SELECT word, count(*) AS cnt FROM ({WORDS}) WHERE word <> '' GROUP BY word")
def stream_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a stream of files, merged batch by batch into a table."""
    merged = accumulate.MergedTable(spark, ["word"], "cnt", lambda a, b: a + b)
    schema = table(spark, sf_dir, "documents").schema.simpleString()[7:-1].replace(":", " ")
    stream = accumulate.read_stream(spark, f"{sf_dir}/documents.parquet*", schema)
    query = accumulate.keep_merged(stream, merged, lambda batch: algorithms.wordcount(batch))
    query.awaitTermination()
    return merged.read()


@register("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour of event time, as the stream's final state."""
    schema = table(spark, sf_dir, "events").schema.simpleString()[7:-1].replace(":", " ")
    stream = accumulate.read_stream(spark, f"{sf_dir}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = accumulate.windowed(stream, "ts", "10 minutes", "1 hour", None, ["event_type"], F.count("*").alias("n"))
    rows = counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    return accumulate.keep_latest(rows)
