"""Queries through files and databases: what is written reads back as the SQL says.

Every query writes whole tables into the shared folder (or an embedded database)
with one of the engine's sinks and reads them with its sources.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.text import split_key_value
from tarnflow.operators import dataflow
from tarnflow.plans import generators
from tarnflow.plans.registry import register, table
from tarnflow.sources import database, files, records, sinks, typed_bytes
from tarnflow.storage import scratch

LINE = "CAST(c_custkey AS VARCHAR) || chr(9) || c_name"


def _customer_lines(spark: SparkSession, sf_dir: str) -> str:
    """A file of lines for each nation, in order of customer."""
    path = scratch(spark, "lines")
    rows = table(spark, sf_dir, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    rows.select("c_nationkey", F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name").alias("value")).write.partitionBy("c_nationkey").text(path)
    return path


def _nation(file: str = "file"):
    return F.regexp_extract(file, r"c_nationkey=(\d+)", 1).cast("int").alias("nation")


@register(
    f"""SELECT c_nationkey AS nation, CAST(coalesce(sum(strlen({LINE}) + 1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place,
        {LINE} AS value, true AS ended FROM customer"""
)
def text_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their byte places in their files."""
    rows = files.read_records_with_offsets(spark, _customer_lines(spark, sf_dir))
    return rows.select(_nation(), F.col("offset").alias("place"), "value", "ended")


@register(f"SELECT c_nationkey AS nation, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 10 AS chunk, {LINE} AS value FROM customer")
def n_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by chunks of ten within their files."""
    return files.read_n_lines(spark, _customer_lines(spark, sf_dir), 10).select(_nation(), "chunk", "value")


@register(f"SELECT {LINE} AS value FROM customer WHERE c_nationkey BETWEEN 10 AND 19")
def text_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the files that a pattern of paths names."""
    return files.read_lines(spark, _customer_lines(spark, sf_dir) + "/c_nationkey=1[0-9]", "*.txt").select("value")


@register("SELECT n, bytes FROM (SELECT count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM benchmark)")
def compressed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written and read compressed; what is not there is not overwritten."""
    path = scratch(spark, "gzip")
    sinks.write_key_value(table(spark, sf_dir, "benchmark").select(F.lit("k").alias("key"), F.regexp_replace("text", "\n", "\r").alias("value")), path, compression="gzip")
    rows = spark.read.option("lineSep", "\n").text(path, pathGlobFilter="*.gz").select(split_key_value(F.col("value"))[1].alias("value"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"))


@register(
    """SELECT CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS key, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN '' ELSE c_name END AS value
    FROM customer WHERE NOT (c_custkey % 7 = 0 AND c_custkey % 5 = 0)"""
)
def key_value_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value lines, where a null side takes the separator with it."""
    path = scratch(spark, "kv")
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("key"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("value"))
    sinks.write_key_value(rows, path)
    return files.read_key_value(spark, path)


@register(
    """SELECT 'string' AS kind, CAST(c_custkey AS INTEGER) AS key, c_name AS name, CAST(NULL AS DOUBLE) AS number FROM customer
    UNION ALL SELECT 'float', CAST(c_custkey AS INTEGER), NULL, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) FROM customer
    UNION ALL SELECT 'double', CAST(c_custkey AS INTEGER), NULL, c_acctbal FROM customer"""
)
def int_key_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Int keys with text, float and double values."""
    customers = table(spark, sf_dir, "customer")
    parts = []
    for kind, value in (("string", "c_name"), ("float", "c_acctbal"), ("double", "c_acctbal")):
        path = scratch(spark, kind)
        sinks.write_key_value(customers.select(F.col("c_custkey").alias("key"), F.col(value).alias("value")), path)
        rows = files.read_int_key_value(spark, path, kind)
        name, number = (F.col("value"), F.lit(None).cast("double")) if kind == "string" else (F.lit(None).cast("string"), F.col("value").cast("double"))
        parts.append(rows.select(F.lit(kind).alias("kind"), "key", name.alias("name"), number.alias("number")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("SELECT c_name AS key, CAST(c_custkey AS VARCHAR) AS value FROM customer")
def sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary key-value container, read as text."""
    path = scratch(spark, "sequence")
    sinks.write_sequence(table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value")), path)
    return files.read_sequence_as_text(spark, path)


@register("SELECT c_name AS key, c_mktsegment AS value FROM customer")
def sequence_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container's records as bytes, written again as they are, and read as records."""
    first, second = scratch(spark, "sequence"), scratch(spark, "binary")
    sinks.write_sequence(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"), first)
    text = "org.apache.hadoop.io.Text"
    sinks.write_sequence_as_binary(files.read_sequence_as_binary(spark, first), second, text, text)
    return files.read_sequence(spark, second)


@register("SELECT kind, CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation, (VALUES ('container'), ('text')) t(kind)")
def detected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and lines told apart by their first bytes, and read together."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    container, text = scratch(spark, "container"), scratch(spark, "text")
    sinks.write_sequence(rows, container)
    sinks.write_key_value(rows, text)
    return files.read_inputs(spark, [(container, files.read_any, lambda f: f.withColumn("kind", F.lit("container"))), (text, files.read_any, lambda f: f.withColumn("kind", F.lit("text")))])


@register("SELECT unnest(regexp_extract_all(html, '(?s)<footer>.*?</footer>')) AS value FROM pages")
def xml_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches between marks, from files split anywhere."""
    path = scratch(spark, "xml")
    table(spark, sf_dir, "pages").select(F.col("html").alias("value")).write.text(path)
    return files.read_xml(spark, path, "<footer>", "</footer>")


@register("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 51, 101, 151)")
def map_file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of single keys from files sorted by key."""
    path = scratch(spark, "map")
    sinks.write_map_file(table(spark, sf_dir, "orders"), path, "o_orderkey", 4)
    found = [sinks.lookup(spark, path, "o_orderkey", k) for k in (1, 51, 101, 151)]
    return dataflow.by_source([(f, lambda f: f.select("o_orderkey", "o_custkey", "o_totalprice")) for f in found])


@register(
    """SELECT 'set' AS kind, count(DISTINCT o_custkey) AS n, CAST(NULL AS BIGINT) AS at_100 FROM orders
    UNION ALL SELECT 'array', count(*), max(o_orderkey) FILTER (place = 100) FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)"""
)
def set_and_array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys alone, and rows by their place."""
    orders, keys, rows = table(spark, sf_dir, "orders"), scratch(spark, "set"), scratch(spark, "array")
    sinks.write_set_file(orders, keys, "o_custkey", 4)
    sinks.write_array_file(orders.select("o_orderkey"), rows, "o_orderkey", 4)
    of_set = spark.read.parquet(keys).agg(F.lit("set").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("long").alias("at_100"))
    return of_set.unionByName(spark.read.parquet(rows).agg(F.lit("array").alias("kind"), F.count("*").alias("n"), F.max(F.when(F.col("index") == 100, F.col("o_orderkey"))).alias("at_100")))


@register("SELECT 'status-' || o_orderstatus AS name, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def dynamic_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each name that the rows give."""
    path = scratch(spark, "by")
    sinks.write_by(table(spark, sf_dir, "orders"), path, F.concat(F.lit("status-"), "o_orderstatus"))
    return spark.read.parquet(path).groupBy("name").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@register("SELECT 'cheap' AS name, count(*) AS n FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT 'finished', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'none', 0")
def named_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side outputs by condition; one without a record is not made."""
    from tarnflow.storage import exists

    paths = {name: scratch(spark, name) for name in ("cheap", "finished", "none")}
    conditions = {"cheap": F.col("o_totalprice") < 50000, "finished": F.col("o_orderstatus") == "F", "none": F.col("o_orderkey") < 0}
    sinks.write_named(table(spark, sf_dir, "orders"), {name: (conditions[name], path) for name, path in paths.items()})
    found = [spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, path in paths.items() if exists(spark, path)]
    missing = [(name, 0) for name, path in paths.items() if not exists(spark, path)]
    return dataflow.by_source([(f, lambda f: f) for f in [*found, spark.createDataFrame(missing, "name string, n long")]])


@register("SELECT 'rows' AS name, count(*) AS value FROM orders UNION ALL SELECT 'large', count(*) FILTER (o_totalprice > 100000) FROM orders UNION ALL SELECT 'open', count(*) FILTER (o_orderstatus = 'O') FROM orders")
def counted_null_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a job whose rows go nowhere."""
    counters = dataflow.Counters(rows=F.lit(1), large=F.col("o_totalprice") > 100000, open=F.col("o_orderstatus") == "O")
    sinks.discard(counters.watch(table(spark, sf_dir, "orders")))
    return spark.createDataFrame(list(counters.values.items()), "name string, value long")


@register("SELECT 5000 AS n, 5000 AS keys, 10 AS key_length, 88 AS value_length")
def tera_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed lines, written and read."""
    path = scratch(spark, "tera")
    sinks.write_tera(generators.tera_rows(spark, 5000), path)
    rows = files.read_tera(spark, path)
    length = lambda c: F.max(F.length(c)).cast("int")
    return rows.agg(F.count("*").cast("int").alias("n"), F.count_distinct("key", "value").cast("int").alias("keys"), length("key").alias("key_length"), length("value").alias("value_length"))


@register("SELECT CAST(c_custkey AS BIGINT) AS key, c_name AS name, c_mktsegment AS segment FROM customer")
def typed_bytes_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as self-describing bytes and back."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.array("c_name", "c_mktsegment").alias("value"))
    decoded = typed_bytes.decode_pairs(typed_bytes.encode_pairs(rows), "key long, value array<string>")
    return decoded.select("key", F.col("value")[0].alias("name"), F.col("value")[1].alias("segment"))


DEFINITIONS = """
module shop {
  class Place { int nation; ustring segment; }
  class Client { long key; ustring name; Place place; double limit; }
}
"""


@register("SELECT CAST(c_custkey AS BIGINT) AS key, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS top FROM customer")
def versioned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written under an older definition, read under a newer one."""
    path = scratch(spark, "records")
    place = F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit("old").alias("dropped"))
    table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("key"), F.col("c_name").alias("name"), place.alias("place")).write.parquet(path)
    wanted = records.parse_records(DEFINITIONS)["Client"]
    return records.read_versioned(spark.read.parquet(path), wanted).select("key", "name", "place.nation", "place.segment", F.col("limit").alias("top"))


# Databases


def _database(spark: SparkSession) -> tuple[str, dict[str, str]]:
    """An embedded database of this process; a cluster names a server's address instead."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return f"jdbc:derby:memory:tarnflow{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def _customers_in_database(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, str]]:
    url, driver = _database(spark)
    # upper case, as the database has names without quotes
    rows = table(spark, sf_dir, "customer").select(*(F.col(c).alias(c.upper()) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
    database.write_jdbc(rows.coalesce(1), url, "customers", createTableColumnTypes="C_NAME VARCHAR(64), C_MKTSEGMENT VARCHAR(32)", **driver)
    return url, driver


CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@register(CUSTOMERS)
def db_scan_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written to a database and read by ranges of an integer."""
    url, driver = _customers_in_database(spark, sf_dir)
    ends = spark.read.jdbc(url, "(SELECT MIN(c_custkey) AS low, MAX(c_custkey) AS high FROM customers) q", properties=driver).first()
    return database.read_jdbc(spark, url, "customers", "c_custkey", ends[0], ends[1], 4, **driver).toDF("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@register(CUSTOMERS)
def db_scan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by ranges of a text."""
    url, driver = _customers_in_database(spark, sf_dir)
    ends = spark.read.jdbc(url, "(SELECT MIN(c_name) AS low, MAX(c_name) AS high FROM customers) q", properties=driver).first()
    return database.read_jdbc(spark, url, "customers", "c_name", ends[0], ends[1], 4, **driver).toDF("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@register("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def db_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by pages of an order."""
    url, driver = _customers_in_database(spark, sf_dir)
    return database.read_pages(spark, url, "customers", ["c_custkey", "c_acctbal"], "c_custkey", 4, "c_acctbal > 0", "fetch", **driver).toDF("c_custkey", "c_acctbal")


@register("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def db_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of the user's own, split by its conditions."""
    url, driver = _customers_in_database(spark, sf_dir)
    query = "SELECT c_nationkey, COUNT(*) AS n FROM customers WHERE $CONDITIONS GROUP BY c_nationkey"
    return database.read_query(spark, url, query, "c_nationkey", 0, 24, 3, **driver).toDF("c_nationkey", "n").withColumn("n", F.col("n").cast("long"))


@register(
    """SELECT 'date' AS kind, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders UNION ALL SELECT 'real', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders
    UNION ALL SELECT 'decimal', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders UNION ALL SELECT 'boolean', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders
    UNION ALL SELECT 'text', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders UNION ALL SELECT 'nulls', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders"""
)
def split_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is in one split, for each type of the split column."""
    orders = table(spark, sf_dir, "orders")
    columns = {
        "date": F.col("o_orderdate"), "real": F.col("o_totalprice"), "decimal": F.col("o_totalprice").cast("decimal(14,2)"), "boolean": F.col("o_orderstatus") == "F",
        "text": F.col("o_orderpriority"), "nulls": F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")),
    }
    found = []
    for kind, column in columns.items():
        rows = orders.select("o_orderkey", column.alias("v"))
        scanned = database.read_split(rows, database.scan_predicates(rows, "v", 5))
        found.append(scanned.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("o_orderkey").alias("total")))
    return dataflow.by_source([(f, lambda f: f) for f in found])
