"""Similarity join of documents on word n-grams, by vertical partitioning.

A document is its set of distinct five-word shingles (64-bit hashes; fewer words:
the whole sequence as one). All shingles have one global order: by the octave of
the number of sets that hold them, rare ones first, then by hash; shingles that
only one set holds come before all others.

1. One pass shingles the texts and deals the shingles to counting tasks by ranges
   of their hash, one range a task, as sparse pieces (a token and the number of its
   document). A task counts in how many sets each of its shingles occurs and
   returns those that others have too, with their octave. Equal sets (by a 128-bit
   key) form a class at once; within a task only one of a class goes on.
2. Each set now knows its order. The order is cut into ``Settings.fragments``
   vertical fragments, and the set into one segment for each. The prefix of a set
   is its n - ceil(t n) + 1 first shingles: two sets of similarity t share one
   there. Only prefix shingles that another set has too go on, dealt by shingle; so
   a document with a fifth of its shingles to itself costs nothing more.
3. First links: each document is paired with the one that leads a shared shingle
   and with its predecessor there, and only with those two that share most of its
   prefix. True links give first components.
4. Closing: wherever documents of different components share a prefix shingle and
   bounds on sizes, places and shared shingles allow a link, they are paired.
   Documents already known to be connected are not paired again, so a group of n
   near copies costs about n pairs, not n squared, and no link between components
   is missed.

The overlap of a pair is counted fragment by fragment: a pair meets the two
segments of one fragment in that fragment's task, keyed by (document, fragment),
which counts their common shingles; an aggregate by pair sums the partial counts,
and the sum decides. Nothing else compares two documents, and no task sees a whole
set. The number of fragments spreads the work and never changes the result.

The few shingles that occur in a thousandth of all documents or more are counted in
all of them beforehand (:func:`frequent_shingles`), left out of the counting by
ranges and are the last in the order; their runs are split by hash of the document.
In closing, every run of many documents is split into blocks by size and hash, and
only the documents outside its main component visit the blocks. The order decides
the cost, never the result.

Defined cases: a null text, or one without words, is the empty set and linked
with nothing; rows of one id are one document, linked if any of their texts are;
rows with a null id have a null component and link nothing; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.common import arrow_schema, id_and_text, most_frequent, parts, slices, to_batch
from tarnflow.llm.components import connected_components
from tarnflow.storage import discard, materialize

#: Classes that a worker remembers; then it starts anew.
CACHE = 200_000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)

#: Bits of a shingle within its range; the number of the range stands above them.
LOW = 40
#: Set in the number of a very frequent shingle; the part of its run stands above it.
HOT, PART = 1 << 62, 24
#: The octave of very frequent shingles: the last.
LAST_OCTAVE = 63
#: Documents that one batch numbers at most.
BATCH_ROWS = 1 << 16
#: Shingles that are hashed at a time.
ROWS = 1 << 13


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: Similarity in percent.
    percent: int = 80
    #: Frequent are the shingles of ``sample * frequent_least`` documents or more, and of
    #: a ``frequent_share`` of all, where documents of more than ``frequent_chars``
    #: characters on average count as several. Every document is counted (``sample``
    #: has its name from a time when one in so many was).
    sample: int = 16
    frequent_share: float = 0.001
    frequent_least: int = 16
    frequent_chars: int = 4000
    #: Such shingles at most, the most frequent; all others are counted by ranges.
    frequent: int = 1 << 18
    #: Half the shingles that a task looks through together for those that may be frequent;
    #: and tasks at most for that, unless they get ``chunk`` each. A task has a share of
    #: ``frequent_task`` documents at least of those that make a shingle frequent.
    chunk: int = 2_000_000
    chunks: int = 64
    frequent_task: int = 32
    #: Shingles that one task counts, about.
    range_size: int = 750_000
    least_ranges: int = 8
    #: Characters of the texts that one batch of pieces holds, about.
    batch_chars: int = 2_000_000
    #: Vertical fragments of the global order.
    fragments: int = 4
    #: Documents of one part of a frequent shingle's run, and of one block of any run.
    part: int = 1024
    block: int = 512
    #: Sets of pairs that are broadcast to find their segments, at most; more are joined.
    sent: int = 100_000

    def prefix(self, n):
        return n - -(-self.percent * n // 100) + 1


def mix(x: np.ndarray) -> np.ndarray:
    return mix_in_place(x.copy())


def mix_in_place(x: np.ndarray) -> np.ndarray:
    """The same, over ``x`` itself."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    return x


def all_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of the texts, ASCII in lower case, as often as they
    occur, and how many each text has."""
    listed = [text.encode("utf-8").lower().split() for text in texts]
    words = np.fromiter(map(len, listed), dtype=np.int64, count=len(listed))
    ends, n = np.cumsum(words), int(words.sum())
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(listed)), dtype=np.uint64, count=n)
    values, total = np.r_[values, np.zeros(size - 1, dtype=np.uint64)], np.zeros(n, dtype=np.uint64)
    for low in range(0, n, ROWS):  # blocks that stay in the processor's cache
        part = total[low : low + ROWS]
        for k, by in enumerate(np.resize(MULTIPLIERS, size)):
            part += mix_in_place(values[low + k : low + k + len(part)] * by + np.uint64(k + 1))
    valid = np.arange(n) + size <= np.repeat(ends, words)
    for k in np.flatnonzero((words > 0) & (words < size)).tolist():
        start, few = ends[k] - words[k], int(words[k])
        total[start] = (values[start : ends[k]] * np.resize(MULTIPLIERS, few)).sum() + np.uint64(few)
        valid[start] = True
    return mix_in_place(total[valid]), np.where(words < size, np.minimum(words, 1), words - size + 1)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text."""
    found, numbers = all_shingles(texts, size)
    return [np.unique(x) for x in np.split(found, np.cumsum(numbers)[:-1])]


def shingles(text: str, size: int) -> np.ndarray:
    return shingle_sets([text], size)[0]


def key_of(found: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of the set, as two signed longs."""
    if not len(found):
        return 0, 0
    digest = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def counted_above(h: np.ndarray, above: np.ndarray, held: list[np.ndarray], bound: float, cut: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes with more than ``cut``, and how much: what they had ``above``
    (``h``, sorted) and have in ``held``, which is emptied, less ``bound``."""
    found = np.concatenate([h[:0], *held])
    held.clear()
    found.sort()
    least = int(bound + cut)
    first = found[: max(0, len(found) - least)]  # with more than both, if the one so far on is equal
    every = np.concatenate([h, first[first == found[least:]]])
    every.sort()
    every = every[np.diff(every, prepend=~every[:1]) != 0]
    n = np.searchsorted(found, every, "right") - np.searchsorted(found, every) - bound
    n[np.searchsorted(every, h)] += above
    return every[n > cut], n[n > cut]


def frequent_shingles(docs: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that very many documents share, rarest first, at most
    ``s.frequent`` of them; and in how many parts (a power of two) the run of each is cut.

    Both come from all documents, in two passes. Each task has a bound, its share of
    half of ``least`` by characters, and hands on what its shingles have above it. A
    shingle of ``least`` documents has ``least`` / 2 above the bounds in all, wherever
    its documents are, and one with so much occurs as often at least, so there are few.
    The documents with each of these are counted.

    Half of a task's bound is taken off piece by piece, so that it remembers few
    shingles, the other half at its end. The bound does not fall as the table grows:
    there is a task for every ``s.frequent_task`` of ``least``, and so the rows of all
    tasks grow as the table does.
    """
    rows = id_and_text(docs).filter("doc_id IS NOT NULL")
    extent = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    chars = extent["chars"] or 0
    least = max(s.sample * s.frequent_least, math.ceil(s.frequent_share * max(extent["n"], chars / s.frequent_chars)))
    if extent["n"] < least or not chars:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, above = np.empty(0, dtype=np.uint64), np.empty(0)
        held: list[np.ndarray] = []
        many = size = total = 0
        for batch in batches:
            for _, texts in parts(batch):
                found, _ = all_shingles(texts, s.words)  # repeated ones make it more at most
                held.append(found)
                size += sum(map(len, texts))
                many += len(found)
                if many >= 2 * s.chunk:
                    h, above = counted_above(h, above, held, least * size / chars / 4)
                    total += size
                    many = size = 0
        cut = least * (total + size) / chars / 4
        h, above = counted_above(h, above, held, least * size / chars / 4, cut)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(above - cut)], names=["h", "above"])

    tasks = min(max(s.chunks, chars // (6 * s.chunk)), max(1, least // s.frequent_task))
    maybe = rows.coalesce(tasks).mapInArrow(look, "h long, above double").groupBy("h").agg(F.sum("above").alias("above"))
    maybe = materialize(maybe.filter(F.col("above") > 0.4999 * least), "frequent")
    chosen = np.sort(most_frequent(maybe, "above", s.frequent)[0].toPandas()["h"].to_numpy(dtype=np.int64).view(np.uint64))
    discard(maybe)
    if not len(chosen):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = sent.value
        n = np.zeros(len(chosen), dtype=np.int64)
        for batch in batches:
            for _, texts in parts(batch):
                found, numbers = all_shingles(texts, s.words)
                at = np.minimum(np.searchsorted(chosen, found), len(chosen) - 1)
                here = chosen[at] == found
                owner = np.repeat(np.arange(len(texts)), numbers)[here]
                n += np.bincount(np.unique(owner * len(chosen) + at[here]) % len(chosen), minlength=len(chosen))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["k", "n"])

    total = np.zeros(len(chosen), dtype=np.int64)
    counts = rows.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # at most s.frequent rows
    total[counts["k"]] = counts["n"]
    often = total >= least
    chosen, total = chosen[often], total[often]
    order = np.lexsort((chosen.view(np.int64), total))
    share = total[order] / s.part
    return chosen[order], (1 << np.ceil(np.log2(np.maximum(share, 1))).astype(np.int64))


PIECES = "batch long, r int, place int, doc_id long, n long, k1 long, k2 long, rep long, hot binary, owners binary, low binary, high binary"
COUNTED = "batch long, r int, place int, doc_id long, n long, k1 long, k2 long, rep long, hot binary, owners binary, low binary, high binary, octaves binary"


def pieces(docs: DataFrame, order: np.ndarray, s: Settings, count: int) -> DataFrame:
    """The sets of some neighbouring documents, a batch, cut by ``count`` ranges of the hash.

    A row with a ``place`` stands for one document: size and key of its set, the
    first row of its class in the same task (``rep``), and the numbers of its very
    frequent shingles (null if another row stands for the class, or the set is
    empty). A row without stands for a range ``r``: the lower ``LOW`` bits of the
    shingles (``low``, ``high``), and the place of the document that has each.
    """
    by_hash = np.argsort(order)
    known = docs.sparkSession.sparkContext.broadcast((order[by_hash], by_hash.astype(np.uint32)))
    kinds = arrow_schema(docs.sparkSession, PIECES)

    def cut(ids: list, texts: list[str], seen: dict) -> pa.RecordBatch:
        frequent, number = known.value
        sets, rows = [], []
        for doc_id, found in zip(ids, shingle_sets(texts, s.words)):
            n, (k1, k2) = len(found), key_of(found)
            rep, hot = None, None
            if n and doc_id is not None:
                rep = seen.get((k1, k2))
                if rep is None:
                    if len(seen) >= CACHE:
                        seen.clear()
                    rep, hot = seen.setdefault((k1, k2), doc_id), b""
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                        often = frequent[at] == found
                        hot, found = np.sort(number[at[often]]).tobytes(), found[~often]
            sets.append(found[:0] if hot is None else found)
            rows.append((len(rows), doc_id, n, k1, k2, rep, hot, None, None, None))
        batch = xxhash.xxh3_64_intdigest(repr(rows)) - (1 << 63)
        rows = [(batch, batch % count, *row) for row in rows]
        sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        r = ((flat >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        by_range = np.argsort(r, kind="stable")
        flat, owner = flat[by_range], owner[by_range]
        low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint8)
        ends = np.cumsum(np.bincount(r, minlength=count)).tolist()
        for k, (start, end) in enumerate(zip([0, *ends], ends)):
            if start < end:
                rows.append((batch, k, *[None] * 7, owner[start:end].tobytes(), low[start:end].tobytes(), high[start:end].tobytes()))
        return to_batch(dict(zip(kinds.names, map(list, zip(*rows)))), kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            for ids, texts in parts(batch, s.batch_chars):
                for at in range(0, len(ids), BATCH_ROWS):
                    yield cut(ids[at : at + BATCH_ROWS], texts[at : at + BATCH_ROWS], seen)

    return id_and_text(docs).mapInArrow(run, PIECES)


def joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def counted(docs: DataFrame, order: np.ndarray, s: Settings, count: int) -> DataFrame:
    """The pieces with the shingles only that two sets or more have, and the octave of
    their number: 1 for two sets, 2 for up to four, 3 for up to eight."""
    kinds = arrow_schema(docs.sparkSession, COUNTED)
    names = PIECES_NAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of one range."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            whole = batch.column("place").is_valid()
            heads = batch.filter(whole)
            if heads.num_rows:
                yield pa.RecordBatch.from_arrays([*heads.columns, pa.nulls(heads.num_rows, pa.binary())], schema=kinds)
            held.append(batch.filter(pa.compute.invert(whole)).select(["batch", "r", "owners", "low", "high"]))
        rows = pa.Table.from_batches(held) if held else None
        held.clear()
        if not rows or not rows.num_rows:
            return
        sizes = np.array([len(x) for x in rows.column("high").to_pylist()])
        code = joined(rows.column("high"), np.uint8).astype(np.uint64) << np.uint64(32) | joined(rows.column("low"), np.uint32)
        order = np.argsort(code)
        ranked = code[order]
        start = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        number = np.diff(np.r_[start, len(ranked)])
        octave = np.empty(len(code), dtype=np.uint8)
        octave[order] = np.repeat(np.ceil(np.log2(number)).astype(np.uint8), number)
        del order, ranked, start, number
        many = octave > 0
        code, octave, owner = code[many], octave[many], joined(rows.column("owners"), np.uint16)[many]
        rows = rows.select(["batch", "r"])
        ends = np.r_[0, np.cumsum(many)][np.cumsum(sizes)]
        low, high = code.astype(np.uint32), (code >> np.uint64(32)).astype(np.uint8)
        bounds = list(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()))
        out = {c: rows.column(c).to_pylist() for c in ("batch", "r")} | dict.fromkeys(names[2:9], [None] * rows.num_rows)
        out |= {c: [x[a:b].tobytes() for a, b in bounds] for c, x in (("owners", owner), ("low", low), ("high", high), ("octaves", octave))}
        yield to_batch(out, kinds).filter(pa.array(np.diff(np.r_[0, ends]) > 0))

    return pieces(docs, order, s, count).repartitionById(count, F.col("r")).mapInArrow(run, COUNTED)


PIECES_NAMES = [field.split()[0] for field in PIECES.split(", ")]


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows that arrive sorted by a column without nulls, a table for each value."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(column).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            if held and held[0].column(column)[0].as_py() != key[low]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def fragment_of(octave: np.ndarray, code: np.ndarray, count: int, fragments: int) -> np.ndarray:
    """The vertical fragment of each shingle: an octave takes half of what the one
    before it left of the order, and its hashes go on from there in order."""
    before = 1 - np.exp2(1.0 - octave)
    return np.minimum((fragments * (before + np.exp2(-1.0 * octave) * (code / float(count << LOW)))).astype(np.int64), fragments - 1)


def packed(code: np.ndarray) -> bytes:
    """48 bits of a hash of each shingle: the lower 32 of all, then the upper 16."""
    mixed = mix(code.view(np.uint64) * MULTIPLIERS[0])
    return mixed.astype(np.uint32).tobytes() + (mixed >> np.uint64(32)).astype(np.uint16).tobytes()


#: Rows of a document (0), of a prefix shingle (1) and of a segment (2).
SETS = "kind int, x long, n long, v long, k2 long, rep long, run long, h long, p int, s int, f int, tokens binary"


def split_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """All documents, prefix shingles and segments, from all rows of a batch at a time.

    ``kind`` 0: a document ``x`` with size ``n`` and key ``v, k2`` of its set and the
    first row ``rep`` of its class in the same task. 1: a prefix shingle ``h`` that
    another set has too, at place ``p`` of the order of a set of ``n``, with the
    number ``s`` of such shingles of the set and the ``run`` in which to look for
    the others. 2: the shingles (``tokens``) of a set in fragment ``f`` that other
    sets have too; only of sets with rows of kind 1. A set is known by ``x, v``.
    """
    letters = id_and_text(docs).agg(F.sum(F.length("text")).alias("c")).first()["c"] or 0
    count = max(s.least_ranges, -(-letters // (6 * s.range_size)))
    order, cuts = frequent_shingles(docs, s)
    cut = docs.sparkSession.sparkContext.broadcast(cuts)
    kinds = arrow_schema(docs.sparkSession, SETS)

    def table(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(rows, f.type) for f in kinds], schema=kinds)

    def of_batch(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        heads = rows.filter(rows.column("place").is_valid()).select(["place", "doc_id", "n", "k1", "k2", "rep", "hot"])
        listed = [heads.column(c).to_pylist() for c in ("doc_id", "n", "k1", "k2", "rep")]
        yield table(heads.num_rows, kind=[0] * heads.num_rows, **dict(zip(("x", "n", "v", "k2", "rep"), listed)))
        # a batch that was read twice (the same rows in two tasks) counts once
        docs_of = {row["place"]: row for row in heads.to_pylist()}
        docs_of = [docs_of[k] for k in sorted(docs_of)]
        every = rows.filter(rows.column("place").is_null()).select(["r", "owners", "low", "high", "octaves"])
        every = list({row["r"]: row for row in every.to_pylist()}.values())

        def column(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(row[name] for row in every), dtype=kind)

        r = np.repeat(np.array([row["r"] for row in every], dtype=np.int64), [len(row["high"]) for row in every])
        code = r << LOW | column("high", np.uint8).astype(np.int64) << 32 | column("low", np.uint32)
        owner, octave = column("owners", np.uint16).astype(np.int64), column("octaves", np.uint8)
        hot = [np.frombuffer(row["hot"] or b"", dtype=np.uint32) for row in docs_of]
        n = np.array([row["n"] for row in docs_of], dtype=np.int64)
        shared = np.bincount(owner, minlength=len(docs_of))
        alone = n - shared - np.fromiter(map(len, hot), dtype=np.int64, count=len(hot))
        need = np.where([row["hot"] is not None for row in docs_of], s.prefix(n) - alone, 0)
        mine = need[owner] > 0
        hot = [x if k > 0 else x[:0] for x, k in zip(hot, need)]
        often = np.repeat(np.arange(len(hot)), list(map(len, hot)))
        owner, code = np.r_[owner[mine], often], np.r_[code[mine], HOT + np.concatenate([np.empty(0, np.int64), *hot]).astype(np.int64)]
        octave = np.r_[octave[mine], np.full(len(often), LAST_OCTAVE, np.uint8)]
        order = np.lexsort((code, owner << 6 | octave))
        owner, code, octave = owner[order], code[order], octave[order]
        place = np.arange(len(code)) - np.searchsorted(owner, owner)
        kept = place < need[owner]
        at, h = owner[kept], code[kept]
        if not len(h):
            return
        x, v = (np.array([row[c] or 0 for row in docs_of], dtype=np.int64) for c in ("doc_id", "k1"))
        run = h.copy()
        is_hot = h >= HOT
        run[is_hot] += (mix(x[at[is_hot]].view(np.uint64)).astype(np.int64) & (cut.value[h[is_hot] - HOT] - 1) & 0x3FFFFFFF) << PART
        yield table(len(h), kind=np.ones(len(h), np.int32), x=x[at], n=n[at], v=v[at], run=run, h=h, p=(place[kept] + alone[at]).astype(np.int32), s=np.bincount(at, minlength=len(n))[at].astype(np.int32))
        fragment = fragment_of(octave, np.where(code >= HOT, 0, code), count, s.fragments)
        start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1])])
        end = np.r_[start[1:], len(code)]
        yield table(len(start), kind=np.full(len(start), 2, np.int32), x=x[owner[start]], v=v[owner[start]], f=fragment[start].astype(np.int32), tokens=[packed(code[a:b]) for a, b in zip(start.tolist(), end.tolist())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, "batch"):
            yield from of_batch(rows)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted(docs, order, s, count).repartition(n, "batch").sortWithinPartitions("batch").mapInArrow(run, SETS)


SHARED = "h long, p long, n long, s long, x long, v long, lead long, lead_v long, lead_n long, prev long, prev_v long, prev_n long"


def with_leaders(rows: DataFrame) -> DataFrame:
    """The rows ``run, h, p, n, s, x, v`` whose run has others, each with the first row
    of its run (``lead``) and the one before it (``prev``); rows of very frequent
    shingles in any case.

    Rows arrive sorted by run; one of them is remembered at a time.
    """
    kinds = arrow_schema(rows.sparkSession, SHARED)
    inputs = ["run", "h", "p", "n", "s", "x", "v"]
    same_set = [5, 6, 3]  # x, v, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = lead_of_last = prev_of_last = None
        continued = False
        for batch in batches:
            if not batch.num_rows:
                continue
            t = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in inputs])
            if last is not None:
                t = np.concatenate([last[:, None], t], axis=1)
            same = t[0, 1:] == t[0, :-1]
            before = np.r_[continued, same]
            places = np.arange(t.shape[1])
            start = np.maximum.accumulate(np.where(before, 0, places))
            lead = t[same_set][:, start]
            prev = t[same_set][:, np.where(before, np.maximum(places - 1, 0), places)]
            if continued:
                lead[:, start == 0] = lead_of_last[:, None]
                prev[:, 0] = prev_of_last
            many = (before | np.r_[same, False] | (t[1] >= HOT))[:-1]
            if many.any():
                yield to_batch(dict(zip(kinds.names, [c[:-1][many] for c in (*t[1:], *lead, *prev)])), kinds)
            last, lead_of_last, prev_of_last, continued = t[:, -1], lead[:, -1], prev[:, -1], bool(before[-1])
        if last is not None and (continued or last[1] >= HOT):
            yield to_batch(dict(zip(kinds.names, ([c] for c in (*last[1:], *lead_of_last, *prev_of_last)))), kinds)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*inputs).repartition(n, "run").sortWithinPartitions("run", "p", "n", "x", "v").mapInArrow(run, SHARED)


def similar_size(a: str, b: str, s: Settings):
    return F.expr(f"100 * least({a}, {b}) >= {s.percent} * greatest({a}, {b})")


def needed(a: str, b: str, s: Settings):
    """Prefix shingles that two linked sets of these sizes have in common at least."""
    t = s.percent
    least = f"cast(ceil(({t} * ({a} + {b})) / {100 + t}.0D) as long)"
    rest = f"cast(ceil({t} * greatest({a}, {b}) / 100.0D) as long) - 1"
    return F.expr(f"greatest(1, {least} - ({rest}))")


#: Pairs of sets of two documents: ids, keys and sizes.
PAIR = ["a", "va", "na", "b", "vb", "nb"]


def first_pairs(shared: DataFrame, s: Settings) -> DataFrame:
    """For each set of a document b the two leaders or predecessors that share most of
    its prefix, if that is much enough."""
    heads = shared.filter((F.col("h") >= HOT) & (F.col("lead") == F.col("x")) & (F.col("lead_v") == F.col("v")))
    linked = shared.union(with_leaders(heads.withColumn("run", F.col("h"))))
    pair = F.array(*(F.struct(F.col(c).alias("a"), F.col(f"{c}_v").alias("va"), F.col(f"{c}_n").alias("na")) for c in ("lead", "prev")))
    both = linked.select(F.col("x").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb"), F.explode(F.array_distinct(pair)).alias("to")).select("to.*", "b", "vb", "nb")
    shares = both.filter("a <> b").filter(similar_size("na", "nb", s)).groupBy(*PAIR).agg(F.count("*").alias("c"))
    good = shares.filter(F.col("c") * 2 >= needed("na", "nb", s))
    best = F.row_number().over(Window.partitionBy("b", "vb").orderBy(F.desc("c"), "a", "va"))
    return good.withColumn("best", best).filter("best <= 2").select(*PAIR)


def closing_pairs(shared: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """Pairs of sets in different components that may be linked, by their common prefix
    shingles.

    Of each shingle's run the component of most rows is the main one. Every pair
    that counts has a row outside it, a visitor. A run of more than ``s.block`` rows
    is cut into blocks by octaves of size, so that similar sets are in the same or
    in neighbouring ones, and by a hash of the document; every row rests in one
    block, visitors visit all of theirs. A task remembers the rows that rest in one
    block and lets the visitors pass by. A linked pair meets three bounds at its
    first common shingle, and no other pairs leave the task: sizes are similar; at
    most as many shingles stand before it in either set as the two may differ by;
    and either prefix shares as many shingles with any documents as the two must.
    """
    spark = shared.sparkSession
    kinds = arrow_schema(spark, ", ".join(f"{c} long" for c in PAIR))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a pair has its first common shingle at a place of at most n - (least overlap)
    early = shared.select("h", "p", "n", "s", "x", "v").filter(F.expr(f"p <= n - cast(ceil({s.percent} * n / 100.0D) as int)"))
    # labels and runs grow with the corpus, so they are merged at every size
    known = early.join(labels.select(F.col("id").alias("x"), "component").hint("merge"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    labelled = materialize(known, "labelled")
    groups = labelled.groupBy("h", "component").agg(F.count("*").alias("c"))
    runs = groups.groupBy("h").agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("rows"), F.count("*").alias("components"))
    runs = materialize(runs.filter("components > 1").select("h", F.col("most.component").alias("main"), "rows"), "runs")
    # of very frequent shingles there are at most ``s.frequent``
    rows = labelled.filter(F.col("h") < HOT).join(runs.filter(F.col("h") < HOT).hint("merge"), "h").unionByName(labelled.filter(F.col("h") >= HOT).join(F.broadcast(runs.filter(F.col("h") >= HOT)), "h"))
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.0001 * -math.log(s.percent / 100))).cast("int")
    rows = rows.withColumn("parts", F.ceil(F.col("rows") / s.block).cast("int"))
    rows = rows.withColumn("size", F.when(F.col("parts") > 1, size).otherwise(0))
    at = lambda size, block, visits: F.struct(size.cast("int").alias("size"), block.cast("int").alias("block"), F.lit(visits).alias("visits"))
    rest = F.array(at(F.col("size"), F.pmod(F.xxhash64("x"), F.col("parts")), 0))
    near = F.when(F.col("parts") > 1, F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).otherwise(F.array(F.lit(0)))
    visits = F.flatten(F.transform(near, lambda z: F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: at(z, k, 1))))
    places = F.when(F.col("component") != F.col("main"), F.concat(rest, visits)).otherwise(rest)
    met = rows.select("h", "n", "p", "s", "x", "v", "component", F.inline(places))
    met = met.repartition(n, "h", "size", "block").sortWithinPartitions("h", "size", "block", "visits", "n", "x", "v")

    def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows ``n, p, s, ...`` pass the bounds."""
        na, nb = a[:, 0], b[:, 0]
        least = -(-s.percent * (na + nb) // (100 + s.percent))
        rest = -(-s.percent * np.maximum(na, nb) // 100) - 1
        return (a[:, 1] <= na - least) & (b[:, 1] <= nb - least) & (np.minimum(a[:, 2], b[:, 2]) >= least - rest)

    def once(found: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.concatenate(found), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        pending, key = 0, None
        held: list[np.ndarray] = []  # the rows that rest in this block
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "size", "block", "visits")], axis=1)
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "p", "s", "x", "v", "component")], axis=1)
            edges = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            for low, high in zip(edges[:-1], edges[1:]):
                if key is None or (keys[low, :3] != key).any():
                    key, held = keys[low, :3], []
                if not keys[low, 3]:
                    held.append(table[low:high])
                    continue
                if not held:
                    continue
                held = [np.concatenate(held)] if len(held) > 1 else held
                kept = held[0]
                step = max(1, (1 << 20) // len(kept))
                for at in range(low, high, step):
                    rows = table[at : min(high, at + step)]
                    i, j = np.nonzero((kept[:, 5][:, None] != rows[:, 5][None, :]) & (100 * np.minimum(kept[:, :1], rows[:, 0]) >= s.percent * np.maximum(kept[:, :1], rows[:, 0])))
                    good = may_link(kept[i], rows[j])
                    x, y = kept[i[good]][:, [3, 4, 0]], rows[j[good]][:, [3, 4, 0]]
                    if len(x):
                        found.append(np.where((x[:, :1] < y[:, :1]), np.concatenate([x, y], axis=1), np.concatenate([y, x], axis=1)))
                        pending += len(x)
                        if pending > 500_000:
                            found = [once(found)]
                            pending = len(found[0])
                            if pending > 250_000:
                                yield to_batch(dict(zip(kinds.names, found[0].T)), kinds)
                                found, pending = [], 0
        if found:
            yield to_batch(dict(zip(kinds.names, once(found).T)), kinds)

    return met.mapInArrow(run, ", ".join(f"{c} long" for c in PAIR)).distinct()


def common(rows: pa.RecordBatch) -> np.ndarray:
    """The number of tokens that the two segments of each row (at most 65,536) have in common."""
    keys = []
    for name in ("tokens_a", "tokens_b"):
        blobs = rows.column(name).to_pylist()
        sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 6
        low = np.frombuffer(b"".join(b[: 4 * k] for b, k in zip(blobs, sizes.tolist())), dtype=np.uint32).astype(np.uint64)
        high = np.frombuffer(b"".join(b[4 * k :] for b, k in zip(blobs, sizes.tolist())), dtype=np.uint16).astype(np.uint64)
        keys.append((high << np.uint64(32) | low) << np.uint64(16) | np.repeat(np.arange(len(blobs), dtype=np.uint64), sizes))
    both = np.sort(np.concatenate(keys))
    twice = both[1:][both[1:] == both[:-1]]
    return np.bincount((twice & np.uint64(0xFFFF)).astype(np.int64), minlength=rows.num_rows)


def linked_pairs(sets: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """``u, v``: the documents of the ``pairs`` whose whole sets reach the similarity.

    Every pair goes to the task of each fragment that both have a segment in, which
    counts what the two segments have in common; the counts are summed by pair.
    (Segments of one set that two tasks have written are equal, hence the maximum.)
    The last fragment, which has the frequent shingles, is counted first; a pair goes
    on to the others only if all that they hold of the smaller one could suffice.
    """
    last = s.fragments - 1
    segments = sets.filter("kind = 2").select("x", "v", "f", "tokens")
    wanted = pairs.select(F.col("a").alias("x"), F.col("va").alias("v")).union(pairs.select("b", "vb")).distinct()
    if wanted.count() <= s.sent:
        segments = segments.join(F.broadcast(wanted), ["x", "v"], "left_semi")
    of_a = segments.select(F.col("x").alias("a"), F.col("v").alias("va"), "f", F.col("tokens").alias("tokens_a"))
    of_b = segments.select(F.col("x").alias("b"), F.col("v").alias("vb"), "f", F.col("tokens").alias("tokens_b"))
    schema = ", ".join(f"{c} long" for c in PAIR) + ", f int, c int"
    kinds = arrow_schema(sets.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1024):
                yield pa.RecordBatch.from_arrays([*(piece.column(c).cast(kinds.field(c).type) for c in (*PAIR, "f")), pa.array(common(piece), type=pa.int32())], schema=kinds)

    def counts(wide: DataFrame, fragments: range) -> DataFrame:
        """The sum over the fragments of each row's pair and ``f``."""
        rows = wide.join(of_a.hint("merge"), ["a", "va", "f"]).join(of_b.hint("merge"), ["b", "vb", "f"]).select(*PAIR, "f", "tokens_a", "tokens_b")
        summed = rows.mapInArrow(run, schema).groupBy(*PAIR).agg(*(F.max(F.when(F.col("f") == k, F.col("c")).otherwise(0)).cast("long").alias(f"c{k}") for k in fragments))
        return summed.select(*PAIR, sum((F.col(f"c{k}") for k in fragments), F.lit(0)).alias("c"))

    def reach(overlap: str):
        return F.expr(f"100 * {overlap} >= {s.percent} * (na + nb - {overlap})")

    found = pairs.select(*PAIR).join(counts(pairs.select(*PAIR, F.lit(last).alias("f")), range(last, s.fragments)), PAIR, "left").withColumn("overlap", F.coalesce("c", F.lit(0))).drop("c")
    if last:
        others = segments.filter(F.col("f") < last).groupBy("x", "v").agg(F.sum(F.length("tokens") / 6).cast("long").alias("m"))
        for x, v in (("a", "va"), ("b", "vb")):
            found = found.join(others.select(F.col("x").alias(x), F.col("v").alias(v), F.col("m").alias(f"m{x}")).hint("merge"), [x, v], "left")
        found = found.withColumn("most", F.col("overlap") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0)))).filter(reach("most"))
        found = materialize(found.select(*PAIR, "overlap"), "possible")
        rest = counts(found.select(*PAIR, F.explode(F.sequence(F.lit(0), F.lit(last - 1))).alias("f")), range(last))
        found = found.join(rest, PAIR, "left").withColumn("overlap", F.col("overlap") + F.coalesce("c", F.lit(0)))
    return found.filter(reach("overlap")).select(F.col("a").alias("u"), F.col("b").alias("v"))


def class_edges(known: DataFrame) -> DataFrame:
    """``u, v``: links within classes of equal sets. Rows point at the first of their
    class in the same task; only those, one for each task and class, are shuffled."""
    near = known.filter("rep <> x").select(F.col("x").alias("u"), F.col("rep").alias("v"))
    reps = known.filter("rep = x").select("n", F.col("v").alias("k1"), "k2", "x")
    least = reps.groupBy("n", "k1", "k2").agg(F.min("x").alias("v"), F.count("*").alias("copies")).filter("copies > 1")
    return near.union(reps.join(least, ["n", "k1", "k2"]).filter("x <> v").select(F.col("x").alias("u"), "v"))


def join_components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    s = settings
    sets = materialize(split_sets(docs, s), "sets")
    known = sets.filter("kind = 0").select("x", "n", "v", "k2", "rep")
    shared = materialize(with_leaders(sets.filter("kind = 1")), "shared")
    tried = materialize(first_pairs(shared, s), "pairs")
    first = materialize(class_edges(known).union(linked_pairs(sets, tried, s)), "links")
    labels = materialize(connected_components(first), "labels")
    ends = [F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("va")).otherwise(F.col("vb")).alias("va"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("vb")).otherwise(F.col("va")).alias("vb")]
    rest = materialize(closing_pairs(shared, labels, s).join(tried.select(*ends), ["a", "va", "b", "vb"], "left_anti"), "pairs")
    final = materialize(connected_components(first.union(linked_pairs(sets, rest.select(*PAIR), s))), "components")
    known = materialize(known, "known")
    for table in (sets, shared, tried, first, labels, rest):
        discard(table)
    sizes = known.select(F.col("x").alias("doc_id"), F.col("n").alias("n_shingles"))
    return sizes.join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one row for each component: that of the smallest id.

    Of the rows that repeat this id the one of the smallest hash of all columns
    stays. Rows of empty sets are components of their own, so one row of each such id
    stays; rows without id link nothing and all stay.
    """
    gone, again = "__jaccard_join_gone", "__jaccard_join_again"
    found = join_components(docs, settings).filter("doc_id IS NOT NULL")
    found = found.groupBy("doc_id").agg(F.max(F.col("component_id") != F.col("doc_id")).alias("linked"), F.count("*").alias("rows"))
    found = materialize(found.filter("linked OR rows > 1"), "kept")
    key = F.col("doc_id").cast("long")
    single = docs.join(found.select(F.col("doc_id").alias(gone)), key == F.col(gone), "left_anti")
    repeated = docs.join(found.filter("NOT linked").select(F.col("doc_id").alias(again)), key == F.col(again), "left_semi")
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*names)
    least = repeated.groupBy(key.alias(again)).agg(F.min_by(whole, F.xxhash64(whole)).alias("row"))
    return single.select(*names).union(least.select("row.*"))
