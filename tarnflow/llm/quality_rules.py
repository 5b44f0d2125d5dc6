"""Quality rules by compression bands.

zstandard ratios (bytes of UTF-8 over compressed bytes) of the whole document
and of fixed chunks must lie within bands whose limits depend on the length:
above a band the text repeats itself, below it the text is incompressible (keys,
encoded files). Two plain counts come first: few words, and words in repeated
five-word windows.

Defined cases: a null or empty text has zero counts and fails the base rule;
texts shorter than the first band have no ratio test; repeated rows get equal
verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import zstandard
from pyspark.sql import DataFrame

from tarnflow.llm.common import keep_rows, map_texts

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunk_ratio_min double, chunk_ratio_max double"
)


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio. ``whole``: (least bytes, lowest ratio, highest ratio),
    the last row that a document reaches holds; ``chunk``: the same for each
    chunk of ``chunk_bytes`` (a last one under half of that is not tested)."""

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = ((64, 0.70, 2.3), (256, 1.15, 2.9), (512, 1.28, 3.3), (1024, 1.40, 3.6), (2048, 1.45, 4.2), (8192, 1.50, 5.0))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.40, 4.0)
    #: Share of the chunks that may leave the band.
    chunk_share: float = 0.25
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = field(default=5)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in windows found twice or more in the text, the first included."""
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered = bytearray(len(words))
    mark = b"\1" * window
    for at, gram in enumerate(grams):
        if counts[gram] > 1:
            covered[at : at + window] = mark
    return sum(covered)


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = raw.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    found = 0
    for line in lines:
        if line in seen:
            found += bool(line.split())
        else:
            seen.add(line)
    return found


class Rules:
    """The verdict on one text at a time."""

    def __init__(self, bands: Bands) -> None:
        self.bands = bands
        self.compressor = zstandard.ZstdCompressor(level=bands.level)

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.compressor.compress(raw))

    def measure(self, text: str) -> tuple:
        b = self.bands
        raw = text.encode("utf-8")
        words = raw.split()
        n = len(words)
        repeats = repeated_words(words, b.window)
        failed = n < b.min_words or 100 * repeats > b.max_repeat_percent * n
        whole = self.ratio(raw) if raw else 0.0
        chunks = [self.ratio(part) for at in range(0, len(raw), b.chunk_bytes) if len(part := raw[at : at + b.chunk_bytes]) >= b.chunk_bytes // 2]
        limits = [(low, high) for least, low, high in b.whole if len(raw) >= least]
        inside = not limits or limits[-1][0] <= whole <= limits[-1][1]
        out = sum(not b.chunk[0] <= x <= b.chunk[1] for x in chunks)
        kept = not failed and inside and out <= b.chunk_share * len(chunks)
        return (
            n,
            sum(len(w.decode("utf-8")) for w in words) if len(raw) != len(text) else sum(map(len, words)),
            sum(raw.count(bytes((c,))) for c in SYMBOLS),
            duplicate_lines(raw),
            repeats,
            failed,
            kept,
            whole,
            min(chunks, default=None),
            max(chunks, default=None),
        )


def measure_quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """A row of counts, ratios and the verdict for each row of ``docs``: a narrow pass."""

    def work(ids: list, texts: list[str]) -> dict[str, list]:
        rules = Rules(bands)
        rows = list(zip(*map(rules.measure, texts)))
        return dict(zip(names, [ids, *rows]))

    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return map_texts(docs, work, SCHEMA)


def keep_quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``docs`` without the documents that the rules reject."""

    def verdicts(_: list, texts: list[str]) -> list[bool]:
        rules = Rules(bands)
        return [rules.measure(text)[6] for text in texts]

    return keep_rows(docs, verdicts)
