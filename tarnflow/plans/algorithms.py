"""Complete queries: graphs, clustering, matrix iteration, frequent pairs, and others."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.functions.sketches import running_total
from tarnflow.functions.text import matches, tokens
from tarnflow.plans.iterate import IterativeJob, Projection, Projector, Result
from tarnflow.storage import discard, materialize

# The share of its rank that a node passes on, and the rest.
DAMPING, BASE = 0.8, 0.2


def wordcount(df: DataFrame, column: str = "text") -> DataFrame:
    return df.select(F.explode(tokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def grep(df: DataFrame, column: str, pattern: str, group: int = 0) -> DataFrame:
    """Matched texts with their counts, most frequent first."""
    found = df.select(F.explode(matches(F.col(column), pattern, group)).alias("match"))
    return found.groupBy("match").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "match")


def pagerank(edges: DataFrame, iterations: int, threshold: float | None = None, checkpoint_every: int = 1, still: float | None = None) -> Result:
    """Ranks of a link list ``src, dst`` (parallel links count): all sources start
    at 1; a node's next rank is 0.2 + 0.8 x the shares of the nodes that link to it.
    A step reads the state once, so several of them can share a job
    (``checkpoint_every``); with ``still`` they end once no rank moves by more than
    that between checkpoints."""
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = edges.groupBy("src", "dst").agg(F.count("*").alias("links")).join(out, "src")
    static = links.select(F.col("src").alias("sk"), "dst", (F.lit(DAMPING) * F.col("links") / F.col("out")).alias("share"))
    nodes = materialize(edges.select(F.explode(F.array("src", "dst")).alias("dk")).distinct(), "nodes")

    def step(paired: DataFrame, state: DataFrame) -> DataFrame:
        sums = paired.groupBy(F.col("dst").alias("dk")).agg(F.sum(F.col("dv") * F.col("share")).alias("s"))
        return nodes.join(sums, "dk", "left").select("dk", (F.lit(BASE) + F.coalesce("s", F.lit(0.0))).alias("dv"))

    first = edges.select(F.col("src").alias("dk")).distinct().withColumn("dv", F.lit(1.0))
    return IterativeJob(static, first, Projector(F.col("sk")), step).run(iterations, threshold, checkpoint_every, still)


def sssp(edges: DataFrame, source: int, iterations: int, until_stable: bool = False, keep_steps: bool = False) -> Result:
    """Distances ``dk, dv`` of nodes reached within so many relaxations of the
    weighted links ``src, dst, w``. Only nodes whose distance changed send offers.
    With ``keep_steps`` also ``steps``: the relaxations that changed a node's distance,
    as a list of ``hop, dist`` with one item a relaxation at most."""
    spark = edges.sparkSession
    prepared = Projector(F.col("sk")).prepare(edges.groupBy("src", "dst").agg(F.min("w").alias("w")).select(F.col("src").alias("sk"), "dst", "w"))
    state = materialize(spark.range(1).select(F.lit(source).cast("long").alias("dk"), F.lit(0.0).alias("dv"), F.lit(True).alias("fresh")), "state")
    kept = ["steps"] if keep_steps else []
    step = lambda hop, dist: F.array(F.struct(F.lit(hop).alias("hop"), dist.alias("dist")))
    if keep_steps:
        state = state.withColumn("steps", step(0, F.col("dv")))
    turn, left = 0, 1
    try:
        while turn < iterations and left:
            turn += 1
            changed = state.filter("fresh").select("dk", "dv")
            offers = prepared.join(changed, "dk").groupBy(F.col("dst").alias("dk")).agg(F.min(F.col("dv") + F.col("w")).alias("o"))
            better = F.col("o").isNotNull() & (F.col("dv").isNull() | (F.col("o") < F.col("dv")))
            least = F.least("dv", "o")
            steps = [F.when(better, F.concat(F.coalesce("steps", F.array().cast("array<struct<hop:int,dist:double>>")), step(turn, least))).otherwise(F.col("steps")).alias("steps")] if keep_steps else []
            new = state.select("dk", "dv", *kept).join(offers, "dk", "full").select("dk", least.alias("dv"), better.alias("fresh"), *steps)
            before, state = state, materialize(new, "state")
            discard(before)
            left = state.filter("fresh").count()
    finally:
        prepared.unpersist()
    return Result(state.select("dk", "dv", *kept), turn, float(left), not left)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(point: Column, centers: Column) -> Column:
    """The id of the nearest center in a list of ``dk, dv``; ties to the lowest id."""
    return F.array_min(F.transform(centers, lambda c: F.named_struct(F.lit("d"), squared_distance(point, c["dv"]), F.lit("id"), c["dk"])))["id"]


def kmeans(points: DataFrame, centers: DataFrame, iterations: int, threshold: float | None = None) -> Result:
    """Centers ``dk, dv`` (dense vectors) after so many steps over ``sk, sv``. Every
    point needs all centers, which are few; a center without points stays."""

    def step(paired: DataFrame, state: DataFrame) -> DataFrame:
        # the nearest center once for each point, before its dimensions become rows
        near = paired.select(nearest(F.col("sv"), F.col("state")).alias("dk"), "sv").select("dk", F.posexplode("sv").alias("dim", "x"))
        means = near.groupBy("dk", "dim").agg(F.avg("x").alias("x"))
        vectors = means.groupBy("dk").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("new"))
        return state.join(vectors, "dk", "left").select("dk", F.coalesce("new", "dv").alias("dv"))

    moved = F.sqrt(squared_distance(F.col("prev"), F.col("curr")))
    job = IterativeJob(points.select("sk", "sv"), centers, Projector(kind=Projection.ONE2ALL), step, moved)
    return job.run(iterations, threshold)


def assign_clusters(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``sk, center`` of every point; the centers are few (the projection checks that)."""
    return Projector(kind=Projection.ONE2ALL).pair(points, centers).select("sk", nearest(F.col("sv"), F.col("state")).alias("center"))


def gimv(matrix: DataFrame, vector: DataFrame, iterations: int, combine2: Column | None = None, combine_all=F.sum, assign: Column | None = None) -> DataFrame:
    """Generalised matrix-vector products: ``combine2`` of an entry ``m`` and the
    vector's value ``dv``, ``combine_all`` over a row, ``assign`` of the old value
    ``old`` (null if none) and the new one ``new``. Matrix ``i, j, m``; the default
    is the plain product."""
    combine2 = F.col("m") * F.col("dv") if combine2 is None else combine2
    assign = F.col("new") if assign is None else assign

    def step(paired: DataFrame, state: DataFrame) -> DataFrame:
        rows = paired.groupBy(F.col("i").alias("dk")).agg(combine_all(combine2).alias("new"))
        return rows.join(state.withColumnRenamed("dv", "old"), "dk", "left").select("dk", assign.alias("dv"))

    static = matrix.select(F.struct("i", "j").alias("sk"), "i", "j", "m")
    return IterativeJob(static, vector, Projector(F.col("j"), Projection.ONE2MUL), step).run(iterations).state


#: Words that a pair never has, as one text: a word is left out if the text contains it.
STOP_TEXT = "the and for are with this that from was were has have had not but you your they them their there then than who whom whose what when where which while will would"


#: Pairs that a task sorts and counts at once (128 MB).
PAIRS_AT_ONCE = 1 << 24


def _pair_codes(words: np.ndarray, ends: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Each number of a record's sorted list with itself and those before it, as
    ``x << 32 | y``; about ``most`` codes at a time."""
    starts = np.concatenate([ends[:1] * 0, ends[:-1]])
    lengths = ends - starts
    for n in np.unique(lengths[lengths > 0]):
        first = starts[lengths == n]
        # whole records of this length, or some numbers of one long record
        records, step = max(1, most // int(n * n)), max(1, min(int(n), most // int(n)))
        for r in range(0, len(first), records):
            block = words[first[r : r + records, None] + np.arange(n)]
            for x in range(0, int(n), step):
                rows = np.arange(x, min(x + step, n))
                i, j = np.nonzero(rows[:, None] >= np.arange(rows[-1] + 1))
                yield ((block[:, rows[i]] << 32) | block[:, j]).ravel()


def count_pairs(batches: Iterator[pa.RecordBatch], most: int = PAIRS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """``code, n``: the pairs of sorted lists ``words``, counted by so many at once."""
    held, size = [], 0

    def counted() -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(held)
        held.clear()
        codes.sort()
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        found, n = codes[first], np.diff(np.append(first, len(codes)))
        for k in range(0, len(found), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(found[k : k + (1 << 17)]), pa.array(n[k : k + (1 << 17)])], names=["code", "n"])

    for batch in batches:
        lists = batch.column("words")
        ends = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
        for codes in _pair_codes(words[ends[0] : ends[-1]], ends[1:] - ends[0], max(1, most // 16)):
            held.append(codes)
            size += len(codes)
            if size >= most:
                yield from counted()
                size = 0
    if held:
        yield from counted()


#: Tokens that a task remembers the words of.
TOKENS_KEPT = 1 << 18


def record_words(batches: Iterator[pa.RecordBatch], stop_text: str = STOP_TEXT) -> Iterator[pa.RecordBatch]:
    """``r, w``: the distinct words of records ``r, text``: lower case up to the last
    character, which is cut if it sorts before ``a``; two characters at least; not within
    ``stop_text``. Each token of a batch is looked at once."""
    valid, known = re.compile("[a-z]*.", re.DOTALL), {}

    def word(token: str) -> str | None:
        if len(token) < 2 or not valid.fullmatch(token):
            return None
        cut = token[:-1] if token[-1] < "a" else token
        return None if cut in stop_text else cut

    for batch in batches:
        if len(known) > TOKENS_KEPT:
            known.clear()
        lists = pc.split_pattern(batch.column("text"), " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        tokens = lists.flatten().dictionary_encode()
        records = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        words, numbers = {}, np.full(len(tokens.dictionary), -1, np.int64)
        for k, token in enumerate(tokens.dictionary.to_pylist()):
            found = known[token] if token in known else known.setdefault(token, word(token))
            if found is not None:
                numbers[k] = words.setdefault(found, len(words))
        number = numbers[tokens.indices.to_numpy(zero_copy_only=False)]
        kept = number >= 0
        pairs = np.unique((records[kept].astype(np.int64) << 32) | number[kept])
        named = pa.array(list(words), type=pa.string()).take(pa.array(pairs & 0xFFFFFFFF))
        yield pa.RecordBatch.from_arrays([batch.column("r").take(pa.array(pairs >> 32)), named], names=["r", "w"])


def apriori_record_words(records: DataFrame, column: str, stop_text: str = STOP_TEXT) -> DataFrame:
    """``r, w``: the distinct words of each record, written once."""
    rows = records.select(F.monotonically_increasing_id().alias("r"), F.col(column).alias("text")).filter("text IS NOT NULL")
    return materialize(rows.mapInArrow(lambda batches: record_words(batches, stop_text), "r long, w string"), "words")


def apriori_vocabulary(counts: DataFrame, support: int | None = None) -> DataFrame:
    """``w, k``: the words of ``w, n`` numbered in order, without those that cannot reach
    the support: a pair of n records counts 2 n at most, and each of its words is in n."""
    often = counts if support is None else counts.filter(F.col("n") * 2 > support)
    return materialize(running_total(often.select("w", F.lit(1).cast("long").alias("one")), "w", "one").select("w", (F.col("running") - 1).cast("int").alias("k")), "often")


def apriori_counts(each: DataFrame, words: DataFrame) -> DataFrame:
    """``code, cnt``: raw counts of the pairs of known words, without any support. Tasks
    count many pairs of numbers at once before the shuffle."""
    numbered = each.join(words, "w").groupBy("r").agg(F.array_sort(F.collect_list("k")).alias("words")).select("words")
    counted = numbered.mapInArrow(count_pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    same = F.shiftright("code", 32) == F.col("code").bitwiseAND(F.lit((1 << 32) - 1))
    return counted.select("code", F.when(same, F.col("n")).otherwise(F.col("n") * 2).alias("cnt"))


def apriori_named(counted: DataFrame, words: DataFrame) -> DataFrame:
    """``pair, cnt`` of codes: the greater word first."""
    split = counted.select(F.shiftright("code", 32).cast("int").alias("x"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("y"), "cnt")
    named = split.join(words.select(F.col("k").alias("x"), F.col("w").alias("a")), "x").join(words.select(F.col("k").alias("y"), F.col("w").alias("b")), "y")
    return named.select(F.concat_ws("&", "a", "b").alias("pair"), "cnt")


def apriori_pairs(records: DataFrame, column: str, support: int | None = None, stop_text: str = STOP_TEXT) -> DataFrame:
    """``pair, cnt``: a word with itself counts 1 a record, two words 2. With a
    support only counts above it: words that cannot reach it form no pairs. Pairs are
    counted as pairs of numbers."""
    each = apriori_record_words(records, column, stop_text)
    words = apriori_vocabulary(each.groupBy("w").agg(F.count("*").alias("n")), support)
    counted = apriori_counts(each, words)
    return apriori_named(counted if support is None else counted.filter(F.col("cnt") > support), words)


def json_text(line: Column) -> Column:
    """The field ``text`` of a JSON line; null where there is none."""
    return F.get_json_object(line, "$.text")


def radical_inverse(index: Column, base: int, digits: int = 40) -> Column:
    """The digits of an index mirrored at the point."""
    def add(acc, _):
        return F.struct((acc["x"] + (acc["rest"] % base) * acc["scale"]).alias("x"), F.floor(acc["rest"] / base).cast("long").alias("rest"), (acc["scale"] / base).alias("scale"))

    zero = F.struct(F.lit(0.0).alias("x"), index.cast("long").alias("rest"), F.lit(1.0 / base).alias("scale"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), zero, add)["x"]


def pi(spark: SparkSession, points: int) -> DataFrame:
    """``inside, total, pi`` from Halton points of bases 2 and 3 in the unit square."""
    digits = max(1, points.bit_length())
    x, y = (radical_inverse(F.col("id") + 1, base, digits) - 0.5 for base in (2, 3))
    hits = spark.range(points).select((x * x + y * y <= 0.25).cast("long").alias("hit"))
    return hits.agg(F.sum("hit").alias("inside"), F.count("*").alias("total")).withColumn("pi", 4.0 * F.col("inside") / F.col("total"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def fill_missing(edges: DataFrame, nodes: int) -> DataFrame:
    """Links, and for each id from 0 on without one a link to a set other node."""
    spark = edges.sparkSession
    alone = spark.range(nodes).withColumnRenamed("id", "src").join(edges.select("src").distinct(), "src", "left_anti")
    return edges.select("src", "dst").unionByName(alone.withColumn("dst", (F.col("src") * 7919 + 13) % nodes))


def format_graph(lines: DataFrame, column: str = "value") -> DataFrame:
    """``src dst`` lines as numbers; one token alone is a link to a set node."""
    parts = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    src = F.get(parts, F.lit(0)).try_cast("long")
    return lines.select(src.alias("src"), F.coalesce(F.get(parts, F.lit(1)).try_cast("long"), (src * 7919 + 13) % 1000003).alias("dst")).filter("src IS NOT NULL")


def adjacency(edges: DataFrame) -> DataFrame:
    """``src, links``: the text list of each node's targets, in order."""
    return edges.groupBy("src").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), " "), F.lit(" ")).alias("links"))


def trim_dimensions(points: DataFrame, dimensions: int) -> DataFrame:
    """Vectors ``id, dim, val`` folded to ``dim % dimensions``, as shares of the
    vector's total."""
    folded = points.groupBy("id", (F.col("dim") % dimensions).alias("dim")).agg(F.sum("val").alias("val"))
    return folded.withColumn("val", F.col("val") / F.sum("val").over(Window.partitionBy("id")))


# Exact cover


def exact_cover(rows: list[frozenset], columns: list, start: tuple[int, ...] = ()) -> Iterator[tuple[int, ...]]:
    """Sets of rows that cover every column once and contain ``start``, in the order
    of choice: always a column with the fewest rows left."""
    holders: dict[object, set[int]] = {c: set() for c in columns}
    for k, row in enumerate(rows):
        for c in row:
            holders[c].add(k)
    rank = {c: n for n, c in enumerate(columns)}

    def choose(k: int) -> list[tuple[object, set[int]]]:
        """Take the row's columns out, and all rows that clash with it."""
        taken = []
        for c in rows[k]:
            clashing = holders.pop(c)
            for other in clashing:
                for d in rows[other]:
                    if d in holders:
                        holders[d].discard(other)
            taken.append((c, clashing))
        return taken

    def restore(taken: list[tuple[object, set[int]]]) -> None:
        for c, clashing in reversed(taken):
            for other in clashing:
                for d in rows[other]:
                    if d in holders:
                        holders[d].add(other)
            holders[c] = clashing

    def search(chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not holders:
            yield chosen
            return
        column = min(holders, key=lambda c: (len(holders[c]), rank[c]))
        for k in sorted(holders[column]):
            taken = choose(k)
            yield from search((*chosen, k))
            restore(taken)

    for k in start:
        if any(c not in holders for c in rows[k]):
            return
        choose(k)
    yield from search(tuple(start))


def sudoku_rows(board: list[list[int]], box: tuple[int, int]) -> tuple[list[frozenset], list, list[tuple[int, int, int]]]:
    """The exact cover of a board (0: empty) with boxes of (rows, columns)."""
    n = len(board)
    rows, cells = [], []
    for r in range(n):
        for c in range(n):
            for v in range(1, n + 1):
                if board[r][c] in (0, v):
                    square = r // box[0] * (n // box[1]) + c // box[1]
                    rows.append(frozenset([("cell", r, c), ("row", r, v), ("column", c, v), ("box", square, v)]))
                    cells.append((r, c, v))
    columns = [(kind, a, b) for kind in ("cell", "row", "column", "box") for a in range(n) for b in ((range(n)) if kind == "cell" else range(1, n + 1))]
    return rows, columns, cells


def cover_distributed(spark: SparkSession, rows: list[frozenset], columns: list, depth: int = 2) -> DataFrame:
    """``cover``: all solutions, each prefix of ``depth`` choices searched by a task
    of its own, as row numbers in order."""
    prefixes: list[tuple[int, ...]] = [()]
    for _ in range(depth):
        longer: list[tuple[int, ...]] = []
        for prefix in prefixes:
            used = frozenset().union(*(rows[k] for k in prefix))
            left = [c for c in columns if c not in used]
            free = [(k, r) for k, r in enumerate(rows) if not r & used]
            column = min(left, key=lambda c: sum(c in r for _, r in free), default=None)
            longer += [(*prefix, k) for k, r in free if column in r] if left else [prefix]
        prefixes = longer

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prefix in batch.column("prefix").to_pylist():
                found = [sorted(cover) for cover in exact_cover(rows, columns, tuple(prefix))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.list_(pa.int64()))], names=["cover"])

    if not prefixes:
        return spark.createDataFrame([], "cover array<long>")
    frame = spark.createDataFrame([(list(p),) for p in prefixes], "prefix array<long>").repartition(min(len(prefixes), 64))
    return frame.mapInArrow(search, "cover array<long>")


# The cells of the twelve pentominoes.
PENTOMINOES = {
    "F": ((0, 1), (0, 2), (1, 0), (1, 1), (2, 1)),
    "I": ((0, 0), (1, 0), (2, 0), (3, 0), (4, 0)),
    "L": ((0, 0), (1, 0), (2, 0), (3, 0), (3, 1)),
    "N": ((0, 1), (1, 1), (2, 0), (2, 1), (3, 0)),
    "P": ((0, 0), (0, 1), (1, 0), (1, 1), (2, 0)),
    "T": ((0, 0), (0, 1), (0, 2), (1, 1), (2, 1)),
    "U": ((0, 0), (0, 2), (1, 0), (1, 1), (1, 2)),
    "V": ((0, 0), (1, 0), (2, 0), (2, 1), (2, 2)),
    "W": ((0, 0), (1, 0), (1, 1), (2, 1), (2, 2)),
    "X": ((0, 1), (1, 0), (1, 1), (1, 2), (2, 1)),
    "Y": ((0, 1), (1, 0), (1, 1), (2, 1), (3, 1)),
    "Z": ((0, 0), (0, 1), (1, 1), (2, 1), (2, 2)),
}


def pentomino_rows(height: int, width: int, one_sided: bool = False) -> tuple[list[frozenset], list, list[str]]:
    """The exact cover of a rectangle by pentominoes; one-sided pieces may turn but
    not flip, and both forms of a piece are pieces of their own."""
    def turned(cells):
        forms = []
        for _ in range(4):
            cells = [(c, -r) for r, c in cells]
            low_r, low_c = min(r for r, _ in cells), min(c for _, c in cells)
            forms.append(frozenset((r - low_r, c - low_c) for r, c in cells))
        return set(forms)

    pieces: dict[str, set[frozenset]] = {}
    for name, cells in PENTOMINOES.items():
        own, flipped = turned(cells), turned([(r, -c) for r, c in cells])
        if one_sided and own != flipped:
            pieces[name], pieces[name.lower()] = own, flipped
        else:
            pieces[name] = own | flipped
    rows, names = [], []
    for name, forms in pieces.items():
        for form in sorted(forms, key=sorted):
            for r in range(height):
                for c in range(width):
                    cells = frozenset((r + a, c + b) for a, b in form)
                    if all(a < height and b < width for a, b in cells):
                        rows.append(cells | {name})
                        names.append(name)
    return rows, [*pieces, *((r, c) for r in range(height) for c in range(width))], names
