"""Queries over iterative jobs, graphs and numeric programs.

The graph: nodes are parts, with a link from each line item's part to the next
one's of the same order; weights are quantities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.plans import algorithms, generators
from tarnflow.plans.iterate import compare_states
from tarnflow.plans.registry import register, table
from tarnflow.storage import materialize

EDGES = """SELECT l_partkey AS src, lead(l_partkey) OVER w AS dst, l_quantity AS w FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice)"""
EDGE_CTE = f"all_edges AS MATERIALIZED ({EDGES}), edges AS MATERIALIZED (SELECT * FROM all_edges WHERE dst IS NOT NULL)"


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, w`` of the part graph."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_quantity").alias("w"))
    return rows.filter("dst IS NOT NULL")


def pagerank_sql(steps: int) -> str:
    """Unrolled steps as common table expressions ``r0`` and on."""
    parts = ["outs AS (SELECT src, count(*) AS o FROM edges GROUP BY 1)", "links AS MATERIALIZED (SELECT src, dst, count(*) / any_value(o) AS share FROM edges JOIN outs USING (src) GROUP BY 1, 2)", "r0 AS (SELECT DISTINCT src AS dk, 1.0::DOUBLE AS dv FROM edges)"]
    for k in range(steps):
        parts.append(
            f"r{k + 1} AS MATERIALIZED (SELECT coalesce(n.dk, c.dk) AS dk, 0.2 + coalesce(s, 0) AS dv FROM r{k} n FULL JOIN "
            f"(SELECT dst AS dk, sum(0.8 * dv * share) AS s FROM links JOIN r{k} ON src = dk GROUP BY 1) c ON n.dk = c.dk)"
        )
    return ", ".join(parts)


def sssp_sql(steps: int, edges: str = "edges", source: int = 0) -> str:
    parts = [f"d0 AS (SELECT {source}::BIGINT AS dk, 0.0::DOUBLE AS dv)"]
    for k in range(steps):
        parts.append(f"d{k + 1} AS MATERIALIZED (SELECT dk, min(dv) AS dv FROM (SELECT dk, dv FROM d{k} UNION ALL SELECT dst, dv + w FROM {edges} JOIN d{k} ON src = dk) GROUP BY 1)")
    return ", ".join(parts)


@register(f"WITH {EDGE_CTE}, {pagerank_sql(5)} SELECT dk AS node, round(dv, 6) AS rank FROM r5")
def pagerank_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.pagerank(part_edges(spark, sf_dir), 5).state.select(F.col("dk").alias("node"), F.round("dv", 6).alias("rank"))


def first_stable_sql(steps: int, threshold: float) -> str:
    """The first of the unrolled ranks whose summed change is below a threshold."""
    gaps = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.dv - coalesce(b.dv, 0))) AS gap FROM r{k} a LEFT JOIN r{k - 1} b ON a.dk = b.dk" for k in range(1, steps + 1))
    ranks = " UNION ALL ".join(f"SELECT {k} AS k, dk, dv FROM r{k}" for k in range(1, steps + 1))
    return f"gaps AS MATERIALIZED ({gaps}), stop AS (SELECT coalesce(min(k) FILTER (gap < {threshold}), {steps}) AS k FROM gaps), stable AS (SELECT dk, dv FROM ({ranks}) SEMI JOIN stop USING (k))"


@register(f"WITH {EDGE_CTE}, {pagerank_sql(60)}, {first_stable_sql(60, 0.1)} SELECT dk AS node, round(dv, 6) AS rank FROM stable")
def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks once the summed change is below a threshold."""
    edges = materialize(part_edges(spark, sf_dir), "edges")
    return algorithms.pagerank(edges, 60, 0.1).state.select(F.col("dk").alias("node"), F.round("dv", 6).alias("rank"))


@register(f"WITH {EDGE_CTE}, {pagerank_sql(2)} SELECT count(*) AS n, round(sum(abs(a.dv - b.dv)), 4) AS total, round(max(abs(a.dv - b.dv)), 6) AS most, 0::BIGINT AS unmatched FROM r1 a JOIN r2 b ON a.dk = b.dk")
def comp_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two successive states of the ranks compared."""
    edges = materialize(part_edges(spark, sf_dir), "edges")
    out = compare_states(algorithms.pagerank(edges, 1).state, algorithms.pagerank(edges, 2).state)
    return out.select("n", F.round("total", 4).alias("total"), F.round("most", 6).alias("most"), "unmatched")


@register(f"WITH {EDGE_CTE}, {sssp_sql(4)} SELECT dk AS node, dv AS dist FROM d4")
def sssp_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.sssp(part_edges(spark, sf_dir), 0, 4).state.select(F.col("dk").alias("node"), F.col("dv").alias("dist"))


@register(f"WITH {EDGE_CTE}, {sssp_sql(24)} SELECT dk AS node, dv AS dist FROM d24")
def sssp_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances once no step changes any of them."""
    return algorithms.sssp(part_edges(spark, sf_dir), 0, 24, until_stable=True).state.select(F.col("dk").alias("node"), F.col("dv").alias("dist"))


def kmeans_sql(steps: int, k: int) -> str:
    parts = [
        "p AS MATERIALIZED (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)",
        f"c0 AS (SELECT vec_id AS dk, dim, x FROM p WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {k}))",
    ]
    for n in range(steps):
        parts.append(
            f"a{n} AS MATERIALIZED (SELECT vec_id, dk FROM (SELECT p.vec_id, c.dk, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN c{n} c ON p.dim = c.dim GROUP BY 1, 2) "
            f"QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, dk) = 1)"
        )
        parts.append(
            f"c{n + 1} AS MATERIALIZED (SELECT o.dk, o.dim, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN "
            f"(SELECT a.dk, p.dim, avg(p.x) AS x FROM a{n} a JOIN p ON a.vec_id = p.vec_id GROUP BY 1, 2) m ON m.dk = o.dk AND m.dim = o.dim)"
        )
    return ", ".join(parts)


@register(f"WITH {kmeans_sql(3, 8)} SELECT dk AS center, CAST(dim AS INTEGER) AS dim, round(x, 5) AS x FROM c3")
def kmeans_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps from the eight points of lowest id."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sk"), F.col("embedding").cast("array<double>").alias("sv"))
    first = points.orderBy("sk").limit(8).select(F.col("sk").alias("dk"), F.col("sv").alias("dv"))
    state = algorithms.kmeans(points, first, 3).state
    return state.select(F.col("dk").alias("center"), F.posexplode("dv").alias("dim", "x")).select("center", (F.col("dim") + 1).alias("dim"), F.round("x", 5).alias("x"))


def gimv_sql(steps: int) -> str:
    parts = [
        "q AS (SELECT l_partkey % 97 AS i, l_suppkey % 97 AS j, sum(l_quantity) AS m FROM lineitem GROUP BY 1, 2)",
        "mat AS MATERIALIZED (SELECT i, j, m / sum(m) OVER (PARTITION BY i) AS m FROM q)",
        "v0 AS (SELECT j AS dk, 0.001::DOUBLE + j AS dv FROM (SELECT DISTINCT j FROM q))",
    ]
    for k in range(steps):
        parts.append(f"v{k + 1} AS MATERIALIZED (SELECT i AS dk, sum(m * dv) AS dv FROM mat JOIN v{k} ON j = dk GROUP BY 1)")
    return ", ".join(parts)


@register(f"WITH {gimv_sql(3)} SELECT dk AS i, round(dv, 6) AS v FROM v3")
def gimv_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three products of a matrix of quantities, by rows of parts and columns of
    suppliers folded into 97 classes, and a vector."""
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 97).alias("i"), (F.col("l_suppkey") % 97).alias("j")).agg(F.sum("l_quantity").alias("m"))
    matrix = cells.withColumn("m", F.col("m") / F.sum("m").over(Window.partitionBy("i")))
    vector = cells.select(F.col("j").alias("dk")).distinct().withColumn("dv", F.lit(0.001) + F.col("dk"))
    return algorithms.gimv(matrix, vector, 3).select(F.col("dk").alias("i"), F.round("dv", 6).alias("v"))


@register(f"WITH {EDGE_CTE} SELECT dst AS src, src AS dst FROM edges")
def transpose_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.transpose(part_edges(spark, sf_dir))


NODES = 40000


@register(
    f"""WITH {EDGE_CTE} SELECT src, dst FROM edges UNION ALL
    SELECT r AS src, (r * 7919 + 13) % {NODES} AS dst FROM range({NODES}) t(r) WHERE r NOT IN (SELECT src FROM edges)"""
)
def fill_missing_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.fill_missing(part_edges(spark, sf_dir), NODES)


@register(
    """WITH p AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
    f AS (SELECT id, dim % 7 AS dim, sum(abs(x)) AS val FROM p GROUP BY 1, 2)
    SELECT id, CAST(dim AS INTEGER) AS dim, round(val / sum(val) OVER (PARTITION BY id), 5) AS val FROM f"""
)
def trim_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("dim", "x")).select("id", "dim", F.abs(F.col("x").cast("double")).alias("val"))
    return algorithms.trim_dimensions(points, 7).withColumn("val", F.round("val", 5))


DIGITS = 14


@register(
    f"""WITH h AS (SELECT list_sum(list_transform(range({DIGITS}), lambda k: ((i // CAST(pow(2, k) AS BIGINT)) % 2) / pow(2, k + 1))) - 0.5 AS x,
                        list_sum(list_transform(range({DIGITS}), lambda k: ((i // CAST(pow(3, k) AS BIGINT)) % 3) / pow(3, k + 1))) - 0.5 AS y FROM range(1, 10001) t(i))
    SELECT count(*) FILTER (x * x + y * y <= 0.25) AS inside, count(*) AS total, 4.0::DOUBLE * count(*) FILTER (x * x + y * y <= 0.25) / count(*) AS pi FROM h"""
)
def pi_halton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.pi(spark, 10000)


#: A board of four by four with one solution, boxes of two by two.
BOARD = [[1, 0, 0, 0], [0, 0, 3, 0], [0, 4, 0, 0], [0, 0, 0, 2]]


@register("SELECT * FROM (VALUES (0, '1 3 2 4'), (1, '4 2 3 1'), (2, '2 4 1 3'), (3, '3 1 4 2')) t(line, digits)")
def sudoku(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, columns, cells = algorithms.sudoku_rows(BOARD, (2, 2))
    covers = algorithms.cover_distributed(spark, rows, columns)
    known = spark.createDataFrame([(k, *cell) for k, cell in enumerate(cells)], "k long, line int, place int, digit int")
    chosen = covers.select(F.explode("cover").alias("k")).join(known, "k")
    return chosen.groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digit"))), lambda e: e["digit"].cast("string")), " ").alias("digits"))


@register("SELECT 8 AS covers")
def pentomino(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways to fill three by twenty with the twelve pieces."""
    rows, columns, _ = algorithms.pentomino_rows(3, 20)
    return algorithms.cover_distributed(spark, rows, columns, depth=3).agg(F.count("*").cast("int").alias("covers"))


@register("SELECT 5000 AS nodes, true AS in_range")
def generated_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated graph has a link from each node, to nodes of the graph."""
    edges = generators.generate_links(spark, 5000, weighted=True)
    return edges.agg(F.count_distinct("src").cast("int").alias("nodes"), F.bool_and((F.col("dst") >= 0) & (F.col("dst") < 5000) & (F.col("w") > 0)).alias("in_range"))
