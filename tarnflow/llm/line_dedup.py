"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines chooses where a chunk ends,
so an inserted line moves the boundaries next to it only. Lines without a word
neither count nor enter the hash. The unit that is compared is a passage: a run of
two or more lines with words within one chunk, from the first such line to the
last, with the blank lines between them. (A whole chunk is one of them; shorter runs
find what two chunks share where a repeated stretch starts or ends inside them.)
Where the same passage occurs more than once in the corpus, byte for byte, only its
first occurrence stays: that of the smallest id, and there the first in the text.

Steps, none of which gathers anything unbounded:

1. a narrow pass hashes all passages (128 bits); hashes found twice set bits in a
   bitmap sized by their number, up to a fixed size, which is broadcast;
2. a second pass emits the bytes of the passages whose bit is set, and an aggregate
   by (hash, bytes) compares them byte for byte, combining before the shuffle, so
   that a passage held by a third of all rows is one row of each task;
3. occurrences meet the repeated passages by hash, are listed by document, and a
   last pass cuts the texts. The passages of most occurrences, ``Settings.head`` at
   most, are broadcast, so that none of the others has many. Two different passages
   of one hash are left alone.

The bitmap only saves shuffled bytes; a full one would let every passage through.

Defined cases: a null text stays null and an empty one empty; a document is an id
with a text, so rows that repeat both are cut alike and keep their own passages, and
rows of one id with different texts count in order of a hash of the text; null ids
come after all others; other columns pass through unchanged; an empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import arrow_schema, most_frequent, slices, to_batch
from tarnflow.storage import discard, materialize

ID, MARK, CUTS = "__line_dedup_id", "__line_dedup_mark", "__line_dedup_cuts"
LAST = (1 << 63) - 1
MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Settings:
    #: Neighbouring line hashes under the rolling hash.
    window: int = 2
    #: One line in so many ends a chunk, on average.
    divisor: int = 2
    least_lines: int = 2
    most_lines: int = 16
    #: Bits of the bitmap, as powers of two: least and most.
    bitmap_powers: tuple[int, int] = (16, 28)
    #: Repeated passages that are broadcast, at most.
    head: int = 1 << 17


def chunks(lines: list[bytes], s: Settings) -> list[list[int]]:
    """The chunks of a text: the places of their lines that have a word."""
    filled = [k for k, line in enumerate(lines) if line.strip()]
    hashes = [xxhash.xxh3_64_intdigest(lines[k]) for k in filled]
    drop = pow(0x9E3779B97F4A7C15, s.window, 1 << 64)
    found: list[list[int]] = []
    now: list[int] = []
    rolling = 0
    for at, value in enumerate(hashes):
        rolling = (rolling * 0x9E3779B97F4A7C15 + value) & MASK
        if at >= s.window:
            rolling = (rolling - hashes[at - s.window] * drop) & MASK
        now.append(filled[at])
        ends = ((rolling ^ rolling >> 32) * 0xD6E8FEB86659FD93 & MASK) >> 40
        if len(now) >= s.most_lines or (len(now) >= s.least_lines and ends % s.divisor == 0):
            found.append(now)
            now = []
    if now:
        # too short a rest belongs to the chunk before it
        if found and len(now) < s.least_lines:
            now = found.pop() + now
        found.append(now)
    return found


def passages(text: str, s: Settings) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(first line, line after the last, two halves of the 128-bit hash, bytes) of every
    run of ``least_lines`` lines or more within a chunk, by chunk, longest first."""
    if "\n" not in text:
        return
    data = text.encode("utf-8")
    lines = data.split(b"\n")
    starts = np.cumsum([0, *(len(line) + 1 for line in lines)]).tolist()
    for chunk in chunks(lines, s):
        for size in range(len(chunk), s.least_lines - 1, -1):
            for k in range(len(chunk) - size + 1):
                first, last = chunk[k], chunk[k + size - 1]
                part = data[starts[first] : starts[last + 1] - 1]
                digest = xxhash.xxh3_128_digest(part)
                yield first, last + 1, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), part


def _document(docs: DataFrame) -> list:
    """What tells a document: its id, nulls last, and a hash of its text."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)), F.xxhash64(docs["text"].cast("string"))]


def _passage_rows(docs: DataFrame, s: Settings, bitmap=None) -> DataFrame:
    """``id, mark, h1, h2`` of all passages; with a bitmap, only of those whose bit is
    set, with their bytes."""
    schema = "id long, mark long, h1 long, h2 long" + (", passage binary" if bitmap else "")
    kinds = arrow_schema(docs.sparkSession, schema)
    names = kinds.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap else None
        last = len(bits) * 64 - 1 if bitmap else 0
        for batch in (piece for whole in batches for piece in slices(whole)):
            rows = []
            for doc_id, mark, text in zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "text"))):
                for _, _, h1, h2, passage in passages(text, s):
                    if bits is None:
                        rows.append((doc_id, mark, h1, h2))
                    elif bits[(h1 & last) >> 6] >> (h1 & 63) & 1:
                        rows.append((doc_id, mark, h1, h2, passage))
            if rows:
                yield to_batch(dict(zip(names, map(list, zip(*rows)))), kinds)

    doc_id, mark = _document(docs)
    keyed = docs.select(doc_id.alias("id"), mark.alias("mark"), F.col("text").cast("string").alias("text"))
    return keyed.filter(F.instr("text", "\n") > 0).mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(occurrences that may repeat, passages that do): ``id, mark, h1, h2, passage`` and
    ``h1, h2, first, copies``, the latter equal byte for byte."""
    spark = docs.sparkSession
    twice = materialize(_passage_rows(docs, s).groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1"), "twice")
    least, most = s.bitmap_powers
    size = 1 << min(most, max(least, (16 * twice.count()).bit_length()))
    place = F.col("h1").bitwiseAND(F.lit(size - 1))
    words = twice.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(h1 & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    bitmap = spark.sparkContext.broadcast(bits.view(np.uint64))
    discard(twice)
    seen = materialize(_passage_rows(docs, s, bitmap), "passages")
    bitmap.unpersist()
    document = F.struct("id", "mark")
    equal = seen.groupBy("h1", "h2", "passage").agg(F.count("*").alias("copies"), F.min(document).alias("first"))
    alone = equal.groupBy("h1", "h2").agg(F.count("*").alias("texts"), F.max("copies").alias("copies"), F.min("first").alias("first"))
    return seen, materialize(alone.filter("texts = 1 AND copies > 1").drop("texts"), "repeated")


def cuts_of(docs: DataFrame, s: Settings) -> DataFrame:
    """``id, mark, cuts``: the repeated passages of each document, and which of them
    are its own."""
    seen, repeated = repeated_passages(docs, s)
    head, rest = most_frequent(repeated, "copies", s.head)
    keys = ["h1", "h2"]
    often = seen.drop("passage").join(F.broadcast(head.drop("copies")), keys, "left")
    known = often.filter("first IS NOT NULL")
    other = often.filter("first IS NULL").drop("first").join(rest.drop("copies"), keys)
    own = (F.col("first.id") == F.col("id")) & (F.col("first.mark") == F.col("mark"))
    return known.unionByName(other).groupBy("id", "mark").agg(F.collect_set(F.struct("h1", "h2", own.alias("own"))).alias("cuts"))


def cut(text: str | None, listed: list[dict] | None, s: Settings) -> tuple[str | None, int, int, int]:
    """The text without the passages ``listed`` that are not its own or repeat in it;
    how many lines it had, how many are gone, and in how many stretches."""
    if not text:
        return text, 0, 0, 0
    lines = text.split("\n")
    if not listed:
        return text, len(lines), 0, 0
    known = {(x["h1"], x["h2"]): x["own"] for x in listed}
    gone: set[int] = set()
    for start, end, h1, h2, _ in passages(text, s):
        own = known.get((h1, h2))
        if own:
            known[h1, h2] = False  # the first occurrence of all
        elif own is not None:
            gone.update(range(start, end))
    stretches = sum(1 for k in gone if k - 1 not in gone)
    return "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone), stretches


def deduplicate(docs: DataFrame, settings: Settings = Settings(), counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with repeated passages of lines cut from ``text``.

    ``counts`` adds ``n_lines, removed_lines, removed_chunks`` (stretches of removed
    lines; of the columns only ``doc_id`` and ``text`` stay); ``drop_emptied`` leaves
    out rows that had words and lost them all.
    """
    s = settings
    if counts:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    doc_id, mark = _document(docs)
    cuts = cuts_of(docs, s).select(F.col("id").alias(ID), F.col("mark").alias(MARK), F.col("cuts").alias(CUTS))
    joined = docs.withColumns({ID: doc_id, MARK: mark}).join(cuts, [ID, MARK], "left").drop(ID, MARK)
    extra = [T.StructField(name, T.LongType()) for name in ("n_lines", "removed_lines", "removed_chunks")] if counts else []
    schema = T.StructType([*docs.schema.fields, *extra])
    names = [f.name for f in schema.fields]
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole)):
            rows = [cut(text, listed, s) for text, listed in zip(batch.column(at).to_pylist(), batch.column(CUTS).to_pylist())]
            found = [batch.column(k) for k in range(len(columns))]
            found[at] = pa.array([r[0] for r in rows], type=found[at].type)
            if counts:
                found += [pa.array([r[k] for r in rows], type=pa.int64()) for k in (1, 2, 3)]
            out = pa.RecordBatch.from_arrays(found, names=names)
            if drop_emptied:
                out = out.filter(pa.array([not (r[2] and not (r[0] or "").split()) for r in rows], type=pa.bool_()))
            yield out

    return joined.select(*(f"`{c}`" for c in columns), CUTS).mapInArrow(run, schema)
