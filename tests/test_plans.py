import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnflow.plans import algorithms, generators, incremental
from tarnflow.plans.iterate import IterativeJob, Projection, Projector, compare_states, distribute, identity_map


def ranks_of(edges, steps):
    nodes = {a: 1.0 for a, _ in edges}
    out = {a: sum(x == a for x, _ in edges) for a in nodes}
    for _ in range(steps):
        new = {n: 0.2 for n in nodes}
        for a, b in edges:
            new[b] = new.get(b, 0.2) + 0.8 * nodes.get(a, 0) / out[a]
        nodes = new
    return nodes


def distances_of(edges, source):
    found = {source: 0.0}
    for _ in range(len(edges) + 1):
        new = dict(found)
        for a, b, w in edges:
            if a in found and found[a] + w < new.get(b, float("inf")):
                new[b] = found[a] + w
        if new == found:
            return found
        found = new
    return found


def random_edges(seed, nodes=40, n=110):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]


def test_pagerank_steps(spark):
    edges = random_edges(1)
    frame = spark.createDataFrame(edges, "src long, dst long")
    for steps in (1, 3):
        got = {r.dk: r.dv for r in algorithms.pagerank(frame, steps).state.collect()}
        expected = ranks_of(edges, steps)
        assert set(got) == set(expected) and all(got[k] == pytest.approx(v) for k, v in expected.items())
    result = algorithms.pagerank(frame, 200, 1e-6)
    assert result.converged and result.distance < 1e-6


def test_incremental_pagerank_equals_recomputation(spark):
    edges = random_edges(2)
    gone, new = edges[:9], [(3, 77), (77, 5), (78, 1), *random_edges(3, n=5)]
    after = list(edges)
    for e in gone:
        after.remove(e)
    after += new
    frame = spark.createDataFrame(edges, "src long, dst long")
    ranks = spark.createDataFrame([(k, v) for k, v in ranks_of(edges, 120).items()], "node long, rank double")
    delta = spark.createDataFrame([(*e, "-") for e in gone] + [(*e, "+") for e in new], "src long, dst long, op string")
    expected = ranks_of(after, 200)
    got = {r.node: r.rank for r in incremental.incremental_pagerank(frame, ranks, delta, 1e-7).collect()}
    assert set(got) == set(expected)
    assert max(abs(got[k] - v) for k, v in expected.items()) < 1e-4
    same = {r.node: r.rank for r in incremental.incremental_pagerank(frame, ranks, delta.limit(0)).collect()}
    assert all(same[r.node] == pytest.approx(r.rank) for r in ranks.collect())


def test_shortest_paths(spark):
    rng = random.Random(4)
    for seed in (5, 6):
        edges = [(a, b, float(rng.randint(1, 9))) for a, b in random_edges(seed)]
        frame = spark.createDataFrame(edges, "src long, dst long, w double")
        result = algorithms.sssp(frame, 0, 60, until_stable=True)
        old = distances_of(edges, 0)
        assert {r.dk: r.dv for r in result.state.collect()} == old and result.converged
        gone, new = edges[::6], [(a, b, float(rng.randint(1, 9))) for a, b in random_edges(seed + 50, n=6)]
        delta = spark.createDataFrame([(*e, "-") for e in gone] + [(*e, "+") for e in new], "src long, dst long, w double, op string")
        state = spark.createDataFrame(list(old.items()), "node long, dist double")
        after = list(edges)
        for e in gone:
            after.remove(e)
        got = {r.node: r.dist for r in incremental.incremental_sssp(frame, state, delta, 0).collect()}
        assert got == distances_of(after + new, 0)


def test_kmeans(spark):
    points = [(k, [float(k % 2 * 10 + k / 100), 1.0]) for k in range(20)]
    frame = spark.createDataFrame(points, "sk long, sv array<double>")
    centers = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [500.0, 500.0])], "dk long, dv array<double>")
    result = algorithms.kmeans(frame, centers, 10, threshold=1e-9)
    got = {r.dk: r.dv for r in result.state.collect()}
    assert got[0] == pytest.approx([0.09, 1.0]) and got[1] == pytest.approx([10.1, 1.0]) and got[2] == [500.0, 500.0]
    assert result.converged
    assert {r.center for r in algorithms.assign_clusters(frame, result.state).collect()} == {0, 1}


def test_projections_and_gimv(spark):
    matrix = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (1, 0, 5.0)], "i long, j long, m double")
    vector = spark.createDataFrame([(0, 1.0), (1, 2.0)], "dk long, dv double")
    assert {r.dk: r.dv for r in algorithms.gimv(matrix, vector, 1).collect()} == {0: 8.0, 1: 5.0}
    least = algorithms.gimv(matrix, vector, 1, F.col("m") + F.col("dv"), F.min, F.least("old", "new"))
    assert {r.dk: r.dv for r in least.collect()} == {0: 1.0, 1: 2.0}
    static = spark.createDataFrame([(7,), (8,)], "sk long")
    whole = Projector(kind=Projection.ONE2ALL)
    job = IterativeJob(static, vector, whole, lambda paired, state: paired.select(F.col("sk").alias("dk"), F.aggregate("state", F.lit(0.0), lambda a, x: a + x["dv"]).alias("dv")))
    assert {r.dk: r.dv for r in job.run(1).state.collect()} == {7: 3.0, 8: 3.0}
    paired = Projector(F.col("sk") % 2).pair(Projector(F.col("sk") % 2).prepare(static), vector)
    assert {tuple(r) for r in identity_map(paired).collect()} == {(8, 1.0), (7, 2.0)}


def test_state_comparison_and_distribution(spark, tmp_path):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "dk long, dv double")
    b = spark.createDataFrame([(1, 1.5), (2, 2.0), (4, 3.0)], "dk long, dv double")
    got = compare_states(a, b).first()
    assert (got.n, got.total, got.most, got.most_at, got.unmatched) == (2, 0.5, 0.5, 1, 2)
    rows = spark.createDataFrame([("1", "2.5"), ("x", "1")], "key string, value string")
    static, state = distribute(rows, rows, 2, f"{tmp_path}/d")
    assert spark.read.parquet(state).filter("key = 1").first().value == 2.5 and spark.read.parquet(static).count() == 2


def test_accumulators(spark):
    old = spark.createDataFrame([("a", 5), ("b", 1)], "k string, value long")
    new = spark.createDataFrame([("a", -3), ("c", 9)], "k string, value long")
    add = lambda x, y: x + y
    assert {tuple(r) for r in incremental.accumulate(old, new, ["k"], add, keep=F.col("value") > 1).collect()} == {("a", 2), ("c", 9)}
    assert {tuple(r) for r in incremental.accumulate(old, new.limit(0), ["k"], add).collect()} == {("a", 5), ("b", 1)}


def test_fine_grain_equals_recomputation(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice("abcdef") for _ in range(4))) for k in range(30)]
    delta = [(k, v, "-") for k, v in rows[:8]] + [(k, "a z", "+") for k, _ in rows[:5]] + [(100, "q q", "+")]
    job = incremental.FineGrain(lambda r: r.select(F.explode(F.split("value", " ")).alias("k2"), F.col("key").alias("sk"), F.lit(1).alias("v2")), [F.sum("v2").alias("n"), F.min("sk").alias("low")])
    source, changes = spark.createDataFrame(rows, "key long, value string"), spark.createDataFrame(delta, "key long, value string, op string")
    edges, result = job.update(*job.build(source), changes)
    fresh_edges, fresh = job.build(incremental.apply_delta(source, changes))
    assert sorted(map(tuple, result.collect())) == sorted(map(tuple, fresh.collect()))
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, fresh_edges.collect()))
    assert sorted(map(tuple, job.update(edges, result, changes.limit(0))[1].collect())) == sorted(map(tuple, fresh.collect()))


def words_of(line, stop):
    found = set()
    for word in line.split(" "):
        if len(word) >= 2 and all("a" <= c <= "z" for c in word[:-1]):
            word = word[:-1] if word[-1] < "a" else word
            if word not in stop:
                found.add(word)
    return found


def test_frequent_pairs(spark):
    rng = random.Random(8)
    lines = [" ".join(rng.choice(["rose", "red,", "blue", "Sky", "the", "x", "ab1", "9a", "é", "", "sun."]) for _ in range(7)) for _ in range(40)]
    counts = {}
    for line in lines:
        words = words_of(line, algorithms.STOP_TEXT)
        for a in words:
            for b in words:
                pair = f"{max(a, b)}&{min(a, b)}"
                counts[pair] = counts.get(pair, 0) + 1
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.pair: r.cnt for r in algorithms.apriori_pairs(frame, "line").collect()} == counts
    assert {r.pair: r.cnt for r in algorithms.apriori_pairs(frame, "line", 20).collect()} == {k: n for k, n in counts.items() if n > 20}


def test_graph_utilities(spark):
    lines = spark.createDataFrame([("1 2",), ("3\t4",), ("5",), ("",)], "value string")
    assert {tuple(r) for r in algorithms.format_graph(lines).collect()} == {(1, 2), (3, 4), (5, (5 * 7919 + 13) % 1000003)}
    edges = spark.createDataFrame([(1, 2), (1, 1), (0, 2)], "src long, dst long")
    links = algorithms.adjacency(edges)
    assert {tuple(r) for r in links.collect()} == {(1, "1 2 "), (0, "2 ")}
    assert algorithms.fill_missing(edges, 4).count() == 5
    delta = generators.update_links(links, 10, 100, delete=True).collect()
    assert {(r.key, r.op) for r in delta} == {(0, "-"), (1, "-"), (1, "+")}
    assert [r.value for r in delta if r.op == "+"] == ["1 2 8 "]


def test_generators(spark):
    weighted = spark.createDataFrame([(k, k + 1, 1.0) for k in range(50)], "src long, dst long, w double")
    delta = generators.update_weights(weighted, 30)
    assert delta.filter("op = '-'").count() == delta.filter("op = '+'").count() > 0
    matrix, vector = generators.generate_matrix(spark, 50, 3)
    assert vector.count() == 50 and generators.update_matrix(matrix, 20).filter("op IS NULL").count() > 0
    points = generators.generate_points(spark, 40, 12, 4)
    assert points.filter(F.size("vector") != 4).count() == 0
    ops = {r.op for r in generators.update_points(points, 30, 10, 10).collect()}
    assert ops == {"-", "+"}
    assert generators.generate_factors(spark, 5, 3).filter(F.exists("values", lambda x: x >= 1)).count() == 0
    assert generators.random_pairs(spark, 5).count() == 5
    assert generators.sum_lines(spark.createDataFrame([("1.5",), ("x",), ("2",)], "value string")).first().total == 3.5


def test_pi_and_covers(spark):
    assert algorithms.pi(spark, 1000).first().pi == pytest.approx(3.14, abs=0.02)
    rows, columns, _ = algorithms.pentomino_rows(3, 20)
    assert len(columns) == 72
    one_sided = algorithms.pentomino_rows(3, 30, one_sided=True)
    assert len([c for c in one_sided[1] if isinstance(c, str)]) == 18
    board = [[0] * 4 for _ in range(4)]
    covers = algorithms.cover_distributed(spark, *algorithms.sudoku_rows(board, (2, 2))[:2])
    assert covers.distinct().count() == covers.count() == 288
    assert algorithms.cover_distributed(spark, [frozenset("ab")], ["a", "b", "c"]).count() == 0


def test_pairs_are_counted_before_the_shuffle():
    """Long and short lists, in pieces of any size; equal pairs of a piece are one row."""
    lists = [[1, 2, 5], [], [5], [1, 2, 5], list(range(40)), [2, 5]]
    expected = collections.Counter((x, y) for words in lists for x in words for y in words if y <= x)
    for most in (1, 50, 1000, 1 << 20):
        batches = [pa.RecordBatch.from_arrays([pa.array(part, type=pa.list_(pa.int32()))], names=["words"]).slice(1) for part in ([[9], *lists[:3]], [[9], *lists[3:]])]
        got, rows = collections.Counter(), 0
        for batch in algorithms.count_pairs(iter(batches), most):
            for code, n in zip(*(c.to_pylist() for c in batch.columns)):
                got[code >> 32, code & 0xFFFFFFFF] += n
                rows += 1
        assert got == expected
    assert rows == len(expected)


def test_apriori_words_of_odd_lines(spark):
    """A line end within a line is a character as others; words are matched whole."""
    rows = [("zeb1\r pony, pony",), (None,), ("",), ("pony. Pony x zebra\r \u00e9t pon\u00e9 pony\u2028",)]
    got = {r.pair: r.cnt for r in algorithms.apriori_pairs(spark.createDataFrame(rows, "line string"), "line").collect()}
    words = [["pony"], ["pony", "zebra", "pon\u00e9", "pony\u2028"]]
    assert got == collections.Counter(f"{x}&{y}" for w in words for x in w for y in w if x >= y for _ in range(1 if x == y else 2))


def test_incremental_distances_within_relaxations(spark):
    """A long chain is cut off at the bound, as a run on the new links is; distances that
    a deleted link supported come from longer ways again."""
    rng = random.Random(5)
    links = {(k, k + 1): 1.0 for k in range(40)} | {(rng.randrange(30), rng.randrange(30)): float(rng.randint(2, 60)) for _ in range(60)}
    gone = [e for e in links if e[0] % 7 == 3]
    added = {(a, (b * 31 + 7) % 45): links[a, b] for a, b in gone}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src long, dst long, w double")
    delta = spark.createDataFrame([(a, b, links[a, b], "-") for a, b in gone] + [(a, b, w, "+") for (a, b), w in added.items()], "src long, dst long, w double, op string")
    now = [(a, b, w) for (a, b), w in links.items() if (a, b) not in gone] + [(a, b, w) for (a, b), w in added.items()]
    for bound in (3, 12):
        expected = {0: 0.0}
        for _ in range(bound):
            expected = min_of([*expected.items(), *((b, expected[a] + w) for a, b, w in now if a in expected)])
        old = algorithms.sssp(edges, 0, bound, until_stable=True, keep_steps=True).state.selectExpr("dk node", "steps")
        assert {r.node: r.dist for r in incremental.incremental_sssp_steps(edges, old, delta, 0, bound).collect()} == expected


def min_of(offers):
    best = {}
    for node, dist in offers:
        best[node] = min(dist, best.get(node, dist))
    return best


def test_ranks_end_once_they_are_still(spark):
    rng = random.Random(3)
    links = [(a, rng.randrange(30)) for a in range(30) for _ in range(5)]
    edges = spark.createDataFrame(links, "src long, dst long")
    done = algorithms.pagerank(edges, 100, checkpoint_every=5, still=1e-12)
    assert done.converged and done.iterations < 100
    expected = ranks_of(links, 100)
    assert {r.dk: pytest.approx(r.dv, abs=1e-11) for r in done.state.collect()} == expected
