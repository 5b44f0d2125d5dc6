"""Packing of documents into sequences by best-fit decreasing.

Documents longer than a sequence are cut into full windows first; each full
window and each remainder is one piece. Best fit decreasing needs only the sizes:
the number of pieces of each size (at most ``capacity`` numbers) is gathered, and
the driver packs whole runs of equal pieces at a time with a segment tree over
the remaining capacity, which finds the tightest open window. Its result is a
short table of runs. Every piece then computes its own place from its rank among
the pieces of its size. Ranks come from counts by (size, salt), with a salt for each
``group`` pieces of a size, so that no size, however common, meets in one task.

Ids are those of the tokenizers library. They are made by ``tiktoken`` from the same
vocabulary file, which takes a fifth of the time (the order of ids is that of the
merges, and the word pattern is the same); texts with a run of white space that is too
long for its pattern matcher go to the library itself.

Defined cases: a null or empty text is the single end id; equal rows are packed
as separate documents; pieces of equal size are ordered by doc_id and start,
nulls first; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.bpe import byte_letters
from tarnflow.llm.common import arrow_schema, map_texts, to_batch
from tarnflow.storage import materialize

#: The word pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space in one run that the matcher of the pattern gives up on (at about a
#: million, where it keeps a state for each).
LONG_RUN = 20_000
LONG_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, mark long"


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file; a token's id is its merge rank."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[x] for x in token): k for token, k in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def library(path: str):
    import tokenizers  # few texts need it

    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids_of(path: str, text: str) -> np.ndarray:
    """The ids of a whole text, as the library gives them."""
    if len(text) >= LONG_RUN and LONG_SPACE.search(text):
        found = library(path).encode(text, add_special_tokens=False).ids
    else:
        found = encoding(path).encode(text, allowed_special="all")
    return np.array(found, dtype="<u4")


class FitTree:
    """Segment tree over remaining capacity: windows open at each capacity."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def add(self, room: int, first: int, count: int) -> None:
        """``count`` windows numbered from ``first`` have ``room`` left."""
        if count > 0:
            self.runs[room].append((first, count))
            self._change(room, count)

    def take(self, room: int) -> tuple[int, int]:
        first, count = self.runs[room].pop(0)
        self._change(room, -count)
        return first, count

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of ``least`` or more at which a window is open."""
        at = least + self.size
        while not self.count[at]:
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1


def pack_runs(pieces: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit decreasing of ``pieces[size]`` equal pieces each.

    Rows are (size, rank of the first piece, pieces to a window, first window,
    offset there), in order of size and rank: the piece of rank r lies in window
    ``first + (r - rank) // per`` at ``offset + (r - rank) % per * size``.
    """
    tree, windows, rows = FitTree(capacity), 0, []
    for size in sorted(pieces, reverse=True):
        rank, left = 0, pieces[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                per = capacity // size
                first, count, room = windows, -(-left // per), capacity
                windows += count
            else:
                per = room // size
                first, count = tree.take(room)
            used = min(count, -(-left // per))
            tree.add(room, first + used, count - used)
            rows.append((size, rank, per, first, capacity - room))
            placed = min(left, used * per)
            last = placed - (used - 1) * per
            full = used if last == per else used - 1
            tree.add(room - per * size, first, full)
            if full < used:
                tree.add(room - last * size, first + full, 1)
            rank, left = rank + placed, left - placed
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def tokenized_pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents with the checksum of their ids: a narrow pass."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(ids: list, texts: list[str]) -> dict[str, list]:
        rows: list[tuple] = []
        for row, (doc_id, text) in enumerate(zip(ids, texts)):
            raw = ids_of(path, text).tobytes() + end
            total = len(raw) // 4
            for start in range(0, total, capacity):
                part = raw[4 * start : 4 * (start + capacity)]
                crc = zlib.crc32(part)
                rows.append((doc_id, start, len(part) // 4, crc, total, zlib.crc32(b"%d %d" % (row, start), crc)))
        return dict(zip(names, map(list, zip(*rows))))

    names = [part.split()[0] for part in PIECES.split(", ")]
    return map_texts(docs, work, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, group: int = 100_000) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``.

    Small shuffles of pieces (no text, no ids): to count, and to rank. The driver
    gets a number for each size, and one for each ``group`` pieces or so.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, path, end_id, capacity), "pieces")
    sizes = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = pack_runs(sizes, capacity)
    salts = spark.createDataFrame([(size, -(-n // group)) for size, n in sizes.items()], "length long, salts long")
    # as many rows as there are sizes, at most ``capacity``
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", (F.col("mark") % F.col("salts")).cast("long")).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "salt"])
    size, salt, n = (counts[c].to_numpy(dtype=np.int64) for c in ("length", "salt", "n"))
    # pieces of the size in the salts before
    total = np.cumsum(n) - n
    before = total - total[np.searchsorted(size, size)] if len(size) else total
    known = spark.sparkContext.broadcast((size << 40 | salt, before, runs))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def place(batches):
        groups, before, runs = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            size, salt, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "rank"))
            rank = rank + before[np.searchsorted(groups, size << 40 | salt)]
            run = runs[run_of(runs, size, rank)]
            step = rank - run[:, 1]
            columns = {c: batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            columns |= {"sequence_id": run[:, 3] + step // run[:, 2], "offset": run[:, 4] + step % run[:, 2] * size}
            yield to_batch(columns, kinds)

    kinds: pa.Schema = arrow_schema(spark, schema)
    return ranked.mapInArrow(place, schema)


def run_of(runs: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The row of ``runs`` that holds the piece of this size and rank."""
    return np.searchsorted(runs[:, 0] << 48 | runs[:, 1], size << 48 | rank, side="right") - 1
