"""Document fingerprints by locally consistent parsing.

A text is parsed level by level, until one symbol is left. On each level runs of one symbol fold into one;
deterministic coin tossing then gives every symbol a small label from the lowest
bit in which it differs from its left neighbour, again and again, until labels
are below six and still differ between neighbours. A phrase starts at each local
maximum of the labels. Its name is a hash of its symbols, and names are the
symbols of the next level. A label looks at a few neighbours only, so equal
substrings are cut into equal phrases in their interior, at any offset.

The fingerprint is the name of the whole text (16 hex digits) and a min-wise
sketch of the phrase names of all levels but the lowest (``BINS`` values of 8 hex
digits). Likeness is the share of equal values among the bins that either side fills.

The query also needs each document's successor in descending order of id. Ids
are cut at quantiles into ranges (an id of very many rows, and the rows without,
into ranges of a hash of the text), every range gets a copy of the first row of
the next one, and each is read in order with one row of memory: one shuffle of
the text, no global sort.

Defined cases: a null or empty text, and one of a single phrase, has an empty sketch
and is like nothing but an equal text; rows of one id follow each other in order of a
hash of the text; null ids come last; a lone row is its own successor; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import BATCH_CHARS, arrow_schema, id_and_text, map_texts, slices, to_batch

BINS = 64
EMPTY = 0xFFFFFFFF
#: Phrases of this and all higher levels enter the sketch, whatever the length of
#: the text: sketches of different levels would not be alike.
FROM_LEVEL = 2
#: The order of rows without id: the last.
LEAST = -(1 << 63)

ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def toss_table(labels: int) -> np.ndarray:
    """``table[left, own]``: twice the lowest bit that differs, plus own value there."""
    left, own = np.meshgrid(np.arange(labels), np.arange(labels), indexing="ij")
    differ = left ^ own
    bit = np.bitwise_count((differ & -differ) - 1)
    bit[differ == 0] = 0
    return (2 * bit + ((own >> bit) & 1)).astype(np.uint8)


TOSSES = [toss_table(128), toss_table(16), toss_table(8)]


def labels_of(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six; ``first`` marks symbols without a left neighbour."""
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[first] = 0
    differ = symbols ^ left
    lowest = differ & (~differ + ONE)
    bit = np.bitwise_count(lowest - ONE) & np.uint8(63)
    label = (bit << np.uint8(1)) | ((symbols & lowest) != 0)
    for table in TOSSES:
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = 0
        label = table[before, label]
    return label


def fold_runs(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of equal symbols as one symbol that names the run."""
    start = first.copy()
    start[1:] |= symbols[1:] != symbols[:-1]
    if start.all():
        return symbols, first
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, len(symbols))).astype(np.uint64)
    kept = symbols[at]
    return np.where(length > 1, mix(kept ^ (length << np.uint64(40))), kept), first[at]


def phrases(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: names of the phrases, and which of them start a text."""
    symbols, first = fold_runs(symbols, first)
    label = labels_of(symbols, first)
    start = first.copy()
    start[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) if len(label) > 2 else False
    # the last symbol of a text has no right neighbour and starts no phrase
    start[:-1] &= ~first[1:] | first[:-1]
    at = np.flatnonzero(start)
    return names(symbols, at), first[at]


def names(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the symbols of each block that starts at ``at``, in order."""
    length = np.diff(np.append(at, len(symbols)))
    place = (np.arange(len(symbols)) - np.repeat(at, length)).astype(np.uint64)
    return mix(np.add.reduceat(mix(symbols + place * np.uint64(0x9E3779B97F4A7C15)), at) + length.astype(np.uint64))


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(name of each text, its sketch of ``BINS`` values), empty texts named 0."""
    whole = np.zeros(len(texts), dtype=np.uint64)
    sketch = np.full((len(texts), BINS), EMPTY, dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return whole, sketch
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + ONE
    first = np.zeros(len(symbols), dtype=bool)
    first[np.cumsum(sizes)[filled] - sizes[filled]] = True
    flat = sketch.reshape(-1)
    level = 0
    while len(symbols):
        level += 1
        symbols, first = phrases(symbols, first)
        owner = filled[np.cumsum(first) - 1]
        if level >= FROM_LEVEL:
            taken = mix(symbols + np.uint64(level))
            bins = owner * BINS + (taken % np.uint64(BINS)).astype(np.int64)
            np.minimum.at(flat, bins, ((taken >> np.uint64(32)) % np.uint64(EMPTY)).astype(np.uint32))
        # texts of one symbol are done
        done = first & np.r_[first[1:], True]
        whole[owner[done]] = mix(symbols[done] + np.uint64(level))
        symbols, filled, first = symbols[~done], filled[~done[first]], first[~done]
    return whole, sketch


def encode(whole: np.ndarray, sketch: np.ndarray) -> list[str]:
    return [f"{int(name):016x}{row.hex()}" for name, row in zip(whole, map(bytes, sketch.astype(">u4")))]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of equal values among the filled bins, row by row; 1 for equal texts."""
    (name_a, x), (name_b, y) = a, b
    either = (x != EMPTY) | (y != EMPTY)
    equal = ((x == y) & either).sum(axis=1) / np.maximum(either.sum(axis=1), 1)
    return np.where(name_a == name_b, 1.0, np.where((x == y).all(axis=1) & ~either.any(axis=1), 0.0, equal))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row: a narrow pass."""

    def work(ids: list, texts: list[str]) -> dict[str, list]:
        return {"doc_id": ids, "fingerprint": encode(*fingerprints(texts))}

    return map_texts(docs, work, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ranges_of(rows: DataFrame, n: int) -> tuple[np.ndarray, dict[int, int]]:
    """Ascending bounds of ``ord``, at quantiles, and in how many ranges of the hash the
    rows of an ``ord`` with more than one quantile are cut; each such has bounds of its own.
    """
    cuts = np.array(rows.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (10 * n)), dtype=np.int64)
    values, times = np.unique(cuts, return_counts=True)
    heavy = {int(v): int(k) + 1 for v, k in zip(values, times) if k > 1}
    counts = rows.agg(F.count("*").alias("all"), F.count_if(F.col("doc_id").isNull()).alias("null")).first()
    if counts["null"] * n > counts["all"]:
        heavy[LEAST] = -(-counts["null"] * n // counts["all"])
    borders = [x for v in heavy for x in (v, v + 1) if x < 1 << 63]
    return np.unique(np.r_[values, np.array(borders, dtype=np.int64)]), heavy


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows ``part, copy, ord, doc_id, text``, sorted so that within a part every
    row is followed by its successor; the rows with ``copy`` belong to the next part.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumns({"ord": F.coalesce("doc_id", F.lit(LEAST)), "h": F.xxhash64("text")})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, heavy = ranges_of(rows.select("doc_id", "ord"), 4 * n)
    # ranges in descending order of id, those of one id in order of the hash
    lows = np.r_[LEAST, bounds][::-1]
    times = np.array([heavy.get(int(low), 1) for low in lows])
    base = np.cumsum(times) - times

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        at = len(bounds) - np.searchsorted(bounds, ids.to_numpy(dtype=np.int64), side="right")
        high = (hashes.to_numpy(dtype=np.int64) >> 32) + (1 << 31)
        return pd.Series((base[at] + (high * times[at] >> 32)).astype("int32"))

    numbered = rows.withColumn("part", part_of("ord", "h"))
    # bounded: a row for each part
    first = F.max(F.struct("ord", F.bitwise_not("h").alias("nh")))
    heads = sorted((r["part"], r["head"]["ord"], ~r["head"]["nh"]) for r in numbered.select("part", "ord", "h").groupBy("part").agg(first.alias("head")).collect())
    carry = [(head, h, heads[k - 1][0]) for k, (_, head, h) in enumerate(heads)]
    copies = spark.createDataFrame(carry, "ord long, h long, receiver int")
    dealt = numbered.join(F.broadcast(copies), ["ord", "h"], "left").select(
        "ord", "h", "doc_id", "text", F.explode(F.filter(F.array(F.struct(F.col("part"), F.lit(False).alias("copy")), F.struct(F.col("receiver").alias("part"), F.lit(True).alias("copy"))), lambda x: x["part"].isNotNull())).alias("to")
    )
    dealt = dealt.select("to.part", "to.copy", "ord", "h", "doc_id", "text")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "copy", F.desc("ord"), "h", "text")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = arrow_schema(docs.sparkSession, schema)

    def finish(ids: list, texts: list[str], last: str) -> pa.RecordBatch:
        changed = [edited(text, following) for text, following in zip(texts, [*texts[1:], last])]
        whole, sketch = fingerprints([*texts, last, *changed])
        n = len(texts)
        own, after, new = (whole[:n], sketch[:n]), (whole[1 : n + 1], sketch[1 : n + 1]), (whole[n + 1 :], sketch[n + 1 :])
        return to_batch(
            {
                "doc_id": ids, "n_chars": list(map(len, texts)), "edited_sha256": [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in changed],
                "fingerprint": encode(*own), "edited_fingerprint": encode(*new), "near_edited": likeness(own, new), "near_next": likeness(own, after),
            },
            kinds,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        part, size, ended = None, 0, True
        for batch in (piece for whole in batches for piece in slices(whole)):
            for p, copy, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "copy", "doc_id", "text"))):
                if p != part:
                    part, ended = p, False
                if ended:
                    continue  # further rows of the id that heads the next part
                if texts and (copy or size > BATCH_CHARS):
                    yield finish(ids, texts, text)
                    ids, texts, size = [], [], 0
                if copy:
                    ended = True
                else:
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)

    return with_successors(docs).mapInArrow(run, schema)
