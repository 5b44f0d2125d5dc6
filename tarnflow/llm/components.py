"""Connected components by alternating large-star and small-star steps.

Every step is an aggregate (smallest neighbour, combined before the shuffle) and
an equi-join that Spark can split where a node has very many neighbours. Edges
are written to shared storage after each round, so lineage stays short and a
lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.storage import discard, materialize


def _with_smallest(edges: DataFrame) -> DataFrame:
    """``u, v, m``: every edge with the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    marked = _with_smallest(down)
    links = marked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(marked.select("u", F.col("m").alias("v")))
    return links.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component``: each node of the edges ``u, v`` with the smallest node that it reaches.

    Loops, repeated edges and either direction are allowed; an edge with a null
    end is left out; without edges the result is empty.
    """
    now = materialize(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    state = None
    while True:
        before, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(before)
        # stable once every edge points at a node that is smallest among its own
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (seen["n"], seen["h"]):
            break
        state = (seen["n"], seen["h"])
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
