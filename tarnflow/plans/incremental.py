"""Incremental recomputation from deltas ``key, value, op`` (``+`` or ``-``).

An update is the old row with ``-`` and the new one with ``+``. Three levels:

* accumulators: aggregate the delta alone and merge it into the old result;
* fine grain: a preserved table of map outputs (k2, sk, v2) takes the delta, and
  only the keys it touches are reduced again;
* iterative: a converged state takes a structure delta, and changes above a
  threshold travel until none is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.plans.algorithms import BASE, DAMPING
from tarnflow.plans.iterate import Projector
from tarnflow.storage import discard, exists, materialize, numbered_folders


def apply_delta(old: DataFrame, delta: DataFrame) -> DataFrame:
    """The rows after the delta: each ``-`` takes one equal row away."""
    names = old.columns
    return old.exceptAll(delta.filter("op = '-'").select(*names)).unionAll(delta.filter("op = '+'").select(*names))


def accumulate(old: DataFrame, delta: DataFrame, key: list[str], merge: Callable[[Column, Column], Column], keep: Column | None = None, value: str = "value") -> DataFrame:
    """The old result merged by key with the delta's: where one side has no row the
    other's value stands. Rows that do not meet ``keep`` are dropped."""
    joined = old.select(*key, F.col(value).alias("__old")).join(delta.select(*key, F.col(value).alias("__new")), key, "full")
    merged = F.when(F.col("__old").isNull(), F.col("__new")).when(F.col("__new").isNull(), F.col("__old")).otherwise(merge(F.col("__old"), F.col("__new")))
    out = joined.select(*key, merged.alias(value)).filter(F.col(value).isNotNull())
    return out if keep is None else out.filter(keep)


def signed(delta: DataFrame) -> DataFrame:
    """``delta`` with ``sign``, 1 or -1."""
    return delta.withColumn("sign", F.when(F.col("op") == "+", 1).otherwise(-1))


class PreservedStore:
    """Map outputs and results of a fine-grain job in a folder, by version: they outlive
    the session, and a later run updates them from there."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        """The versions that are complete, in order."""
        return [n for n in numbered_folders(self.spark, self.folder) if exists(self.spark, f"{self.folder}/{n}/done/_SUCCESS")]

    def save(self, edges: DataFrame, result: DataFrame) -> int:
        """The next version. Edges are dealt by key, and sorted, so that a reader of few
        keys skips the rest; a version without its last mark does not count."""
        number = max(self.versions(), default=-1) + 1
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        edges.repartition(n, "k2").sortWithinPartitions("k2").write.mode("overwrite").parquet(f"{self.folder}/{number}/edges")
        result.write.mode("overwrite").parquet(f"{self.folder}/{number}/result")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/{number}/done")
        return number

    def load(self, number: int | None = None) -> tuple[DataFrame, DataFrame]:
        number = max(self.versions()) if number is None else number
        return tuple(self.spark.read.parquet(f"{self.folder}/{number}/{name}") for name in ("edges", "result"))


class FineGrain:
    """A preserved map output ``k2, sk, v2`` and its reduced result ``k2, v3``.

    ``map_rows`` turns source rows ``key, value`` into ``k2, sk, v2``; a source may
    give a key several values. ``reduce`` are aggregates over ``v2`` named as wanted.
    """

    def __init__(self, map_rows: Callable[[DataFrame], DataFrame], reduce: list[Column]) -> None:
        self.map_rows, self.reduce = map_rows, reduce

    def build(self, source: DataFrame) -> tuple[DataFrame, DataFrame]:
        edges = self.map_rows(source).select("k2", "sk", "v2")
        return edges, self._reduced(edges)

    def _reduced(self, edges: DataFrame) -> DataFrame:
        return edges.groupBy("k2").agg(*self.reduce)

    def update(self, edges: DataFrame, result: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges and result after a delta: only touched keys are reduced again, and
        keys that are left without edges disappear."""
        gone = self.map_rows(delta.filter("op = '-'")).select("k2", "sk", "v2")
        new = self.map_rows(delta.filter("op = '+'")).select("k2", "sk", "v2")
        touched = materialize(gone.select("k2").union(new.select("k2")).distinct(), "touched")
        # only edges of touched keys can change
        mine = edges.join(touched, "k2", "left_semi").select("k2", "sk", "v2")
        changed = materialize(mine.exceptAll(gone).unionAll(new), "changed")
        rest = edges.join(touched, "k2", "left_anti").select("k2", "sk", "v2")
        return rest.unionByName(changed), result.join(touched, "k2", "left_anti").unionByName(self._reduced(changed))


def incremental_pagerank(edges: DataFrame, ranks: DataFrame, delta: DataFrame, threshold: float = 1e-13, iterations: int = 100) -> DataFrame:
    """Ranks ``node, rank`` after an edge delta ``src, dst, op``, from the converged
    ranks of the old edges.

    Nodes whose rank moved by more than ``threshold`` since they last sent it send
    again; smaller changes add up until they pass it. Nodes without an edge left
    go, new ones start from the base rank.
    """
    names = ["src", "dst"]
    new_edges = materialize(apply_delta(edges.select(*names), delta.select(*names, "op")), "edges")
    old_out = _out_degrees(edges).withColumnRenamed("out", "old_out")
    out = materialize(_out_degrees(new_edges), "out")
    weights = materialize(new_edges.groupBy("src", "dst").agg(F.count("*").alias("links")).join(out, "src"), "weights")
    nodes = new_edges.select(F.col("src").alias("node")).union(new_edges.select(F.col("dst").alias("node"))).distinct()
    # what every node last sent: its old rank; new nodes have sent nothing
    state = materialize(nodes.join(ranks, "node", "left").select("node", F.coalesce("rank", F.lit(BASE)).alias("rank"), F.coalesce("rank", F.lit(0.0)).alias("sent")), "ranks")
    # sources whose links changed change all their contributions
    sources = delta.select("src").distinct()
    before = edges.join(sources, "src", "left_semi").groupBy("src", "dst").agg(F.count("*").alias("links")).join(old_out, "src").join(ranks.withColumnRenamed("node", "src"), "src")
    after = weights.join(sources, "src", "left_semi").join(state.select(F.col("node").alias("src"), "sent"), "src")
    change = before.select(F.col("dst").alias("node"), (-DAMPING * F.col("rank") * F.col("links") / F.col("old_out")).alias("c")).unionAll(
        after.select(F.col("dst").alias("node"), (DAMPING * F.col("sent") * F.col("links") / F.col("out")).alias("c"))
    )
    def received(state: DataFrame, change: DataFrame) -> DataFrame:
        """The ranks with a change; those that moved enough are about to send it."""
        moved = change.groupBy("node").agg(F.sum("c").alias("c"))
        rank = (F.col("rank") + F.coalesce("c", F.lit(0.0))).alias("rank")
        after = state.join(moved, "node", "left").select("node", rank, "sent")
        return after.withColumn("active", F.abs(F.col("rank") - F.col("sent")) > threshold)

    now = materialize(received(state, change), "ranks")
    # dealt by source once, so that a step shuffles no links but those that are sent
    prepared = Projector(F.col("sk")).prepare(weights.withColumnRenamed("src", "sk"))
    for _ in range(iterations):
        if now.filter("active").isEmpty():
            break
        sends = now.filter("active").select(F.col("node").alias("dk"), (F.col("rank") - F.col("sent")).alias("gap"))
        change = prepared.join(sends, "dk").select(F.col("dst").alias("node"), (DAMPING * F.col("gap") * F.col("links") / F.col("out")).alias("c"))
        told = now.select("node", "rank", F.when(F.col("active"), F.col("rank")).otherwise(F.col("sent")).alias("sent"))
        before, now = now, materialize(received(told, change), "ranks")
        discard(before)
    prepared.unpersist()
    return now.select("node", "rank")


def _out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("out"))


def incremental_gimv(matrix: DataFrame, vector: DataFrame, delta: DataFrame, threshold: float = 1e-12, iterations: int = 200) -> DataFrame:
    """The fixpoint ``dk, dv`` of v = M v + b after a delta ``i, j, m, op`` of the entries
    ``i, j, m``, from the old fixpoint ``dk, dv, b``; the rows of M sum to less than one.

    Entries that changed change what their row gets at once; from then on only values
    that moved by more than ``threshold`` since they were last sent travel.
    """
    names = ["i", "j", "m"]
    now = materialize(apply_delta(matrix.select(*names), delta.select(*names, "op")), "matrix")
    signs = signed(delta).select("i", "j", (F.col("m") * F.col("sign")).alias("m"))
    first = signs.join(vector.select(F.col("dk").alias("j"), "dv"), "j").groupBy(F.col("i").alias("dk")).agg(F.sum(F.col("m") * F.col("dv")).alias("c"))

    def received(state: DataFrame, change: DataFrame) -> DataFrame:
        after = state.join(change, "dk", "left").select("dk", (F.col("dv") + F.coalesce("c", F.lit(0.0))).alias("dv"), "sent")
        return after.withColumn("active", F.abs(F.col("dv") - F.col("sent")) > threshold)

    state = materialize(received(vector.select("dk", "dv", F.col("dv").alias("sent")), first), "vector")
    for _ in range(iterations):
        if state.filter("active").isEmpty():
            break
        sends = state.filter("active").select(F.col("dk").alias("j"), (F.col("dv") - F.col("sent")).alias("gap"))
        change = now.join(sends, "j").groupBy(F.col("i").alias("dk")).agg(F.sum(F.col("m") * F.col("gap")).alias("c"))
        told = state.select("dk", "dv", F.when(F.col("active"), F.col("dv")).otherwise(F.col("sent")).alias("sent"))
        before, state = state, materialize(received(told, change), "vector")
        discard(before)
    return state.select("dk", "dv")


def incremental_sssp(edges: DataFrame, distances: DataFrame, delta: DataFrame, source: int, iterations: int = 1000) -> DataFrame:
    """Distances ``node, dist`` of reached nodes after an edge delta
    ``src, dst, w, op``; weights are positive.

    A node whose distance no edge supports any more is reset, and so are the nodes
    that only such nodes supported; then distances relax from the others.
    """
    names = ["src", "dst", "w"]
    now = materialize(apply_delta(edges.select(*names), delta.select(*names, "op")), "edges")
    known = materialize(distances, "distances")
    reset = None
    suspects = delta.filter("op = '-'").select(F.col("dst").alias("node")).distinct()
    for _ in range(iterations):
        alive = known if reset is None else known.join(reset, "node", "left_anti")
        mine = alive.join(suspects, "node", "left_semi").filter(F.col("node") != source)
        support = now.join(alive.select(F.col("node").alias("src"), F.col("dist").alias("d")), "src").join(mine.select(F.col("node").alias("dst"), "dist"), "dst").filter("d + w = dist").select(F.col("dst").alias("node")).distinct()
        lost = materialize(mine.select("node").join(support, "node", "left_anti"), "lost")
        if lost.isEmpty():
            break
        reset = lost if reset is None else materialize(reset.union(lost), "reset")
        suspects = now.join(lost.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    state = known if reset is None else materialize(known.join(reset, "node", "left_anti"), "distances")
    targets = delta.filter("op = '+'").select(F.col("dst").alias("node"))
    touched = materialize((targets if reset is None else targets.union(reset)).distinct(), "touched")
    inward = now.join(touched.select(F.col("node").alias("dst")), "dst", "left_semi")
    offers = inward.join(state.select(F.col("node").alias("src"), "dist"), "src").select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("d"))
    for _ in range(iterations):
        best = offers.groupBy("node").agg(F.min("d").alias("d"))
        better = materialize(best.join(state, "node", "left").filter("dist IS NULL OR d < dist").select("node", F.col("d").alias("dist")), "better")
        if better.isEmpty():
            break
        state = materialize(state.join(better, "node", "left_anti").unionByName(better), "distances")
        offers = now.join(better.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("d"))
    return state


def incremental_sssp_steps(edges: DataFrame, old: DataFrame, delta: DataFrame, source: int, iterations: int) -> DataFrame:
    """Distances ``node, dist`` within so many relaxations after an edge delta
    ``src, dst, w, op``, from ``node, steps`` of the old edges (``steps`` of
    :func:`~tarnflow.plans.algorithms.sssp`, of as many relaxations).

    After each relaxation a node has its old distance of that relaxation, unless it or
    a node that leads to it differs from the old run or one of its links changed: only
    such nodes take offers again.
    """
    names = ["src", "dst", "w"]
    ops = materialize(delta.select(*names, "op"), "delta")
    now = materialize(apply_delta(edges.select(*names), ops), "edges")

    def old_at(hop: int) -> Column:
        return F.array_min(F.transform(F.filter("steps", lambda x: x["hop"] <= hop), lambda x: x["dist"]))

    state = materialize(old.select("node", "steps", F.when(F.col("node") == source, 0.0).alias("dist")), "distances")
    for hop in range(iterations):
        seen = state.select(F.col("node").alias("src"), old_at(hop).alias("old"), "dist").filter("old IS NOT NULL OR dist IS NOT NULL")
        differ = seen.filter(~F.col("old").eqNullSafe(F.col("dist")))
        led = now.join(differ.select("src"), "src", "left_semi").select("dst").unionAll(ops.join(seen.select("src"), "src", "left_semi").select("dst"))
        touched = materialize(led.unionAll(differ.select(F.col("src").alias("dst"))).distinct(), "touched")
        offers = now.join(touched, "dst", "left_semi").join(seen.filter("dist IS NOT NULL"), "src").groupBy("dst").agg(F.min(F.col("dist") + F.col("w")).alias("o"))
        again = touched.join(offers, "dst", "left").select(F.col("dst").alias("node"), "o", F.lit(True).alias("again"))
        dist = F.when(F.col("again"), F.least("dist", "o")).otherwise(old_at(hop + 1))
        new = state.select("node", "steps", "dist").join(again, "node", "full").select("node", "steps", dist.alias("dist"), (~F.col("dist").eqNullSafe(dist)).alias("fresh"))
        before, state = state, materialize(new, "distances")
        for done in (before, touched):
            discard(done)
        if state.filter("fresh").isEmpty():
            break  # a further relaxation changes nothing either
    return state.filter("dist IS NOT NULL").select("node", "dist")
