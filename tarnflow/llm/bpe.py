"""Byte-pair encoding and decoding with a contiguous rank array.

A text is cut at added tokens, normalised, split into words, and each distinct
word is merged once per worker: its part boundaries and the ranks of adjacent
pairs stand in two plain lists, the least rank is found by scanning, one boundary
is deleted and the two neighbouring ranks are looked up anew. Words over
``LONG_WORD`` bytes keep the same order of merges with a heap and linked parts,
since scanning them would take quadratic time.

The vocabulary file is a parameter; it is read by each worker and nothing is
broadcast. Its kinds of steps are those of word-level files with a normaliser
and an end-of-word suffix. Defined cases: a null text is empty and encodes to no
ids; invalid surrogates do not occur in Spark strings; equal rows get equal rows;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tarnflow.llm.common import map_texts

#: Bytes of a word from which on merges go through a heap.
LONG_WORD = 256
#: Distinct words that a worker remembers; then it starts anew.
CACHE_WORDS = 400_000

#: Characters whose classes and lower case are the same in Python and in the
#: tokenizers library: ASCII but for the separators 0x1C-0x1F, Latin letters,
#: and common punctuation. Other texts go through the library's own splitter.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\x7e\xa1\xab\xbb\xbf\xc0-įı-ɏ–—‘’“”…€]")
#: The split pattern of the word-level file, for texts without unusual characters.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Normaliser steps that the plain path stands for.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letter[b] for b in range(256)]


class Words(dict):
    """A bounded memory of what was computed for a word."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = self.compute(word)
        return value


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.tokens = {k: v for v, k in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {k: v for v, k in self.added.items()}
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != NORMALIZERS or splits[:1] != [SPLIT_PATTERN] or spec["decoder"] is not None or model["unk_token"] is not None:
            raise ValueError(f"{path}: not a word-level vocabulary of the known kind")
        self.library = Tokenizer.from_file(path)
        letters = byte_letters()
        self.letter_ids = [vocab[x] for x in letters]
        self.last_ids = [vocab[x + self.suffix] for x in letters]
        self.letter_bytes = {x: b for b, x in enumerate(letters)}
        #: (left id, right id) -> (rank, merged id)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.words = Words(lambda word: self.entry(word.encode("utf-8")))
        self.pieces = Words(lambda piece: self.entry(bytes(self.letter_bytes[x] for x in piece)))

    def entry(self, raw: bytes) -> tuple[bytes, str]:
        """The ids of a word as little-endian bytes, and its decoded tokens."""
        ids = self.merge(raw)
        return np.array(ids, dtype="<u4").tobytes(), " ".join(self.tokens[i] for i in ids)

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.letter_ids[b] for b in raw[:-1]] + [self.last_ids[raw[-1]]]
        return self.scan(ids) if len(ids) <= LONG_WORD else self.heap(ids)

    def scan(self, ids: list[int]) -> list[int]:
        """The contiguous rank array: ``ranks[k]`` is the rank of parts k and k + 1."""
        get, none = self.pairs.get, (1 << 60, -1)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least is none or least[1] < 0:
                break
            at = ranks.index(least)
            ids[at] = least[1]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), none)
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), none)
        return ids

    def heap(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, for long words."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right >= 0 and (found := self.pairs.get((ids[left], ids[right]))):
                heapq.heappush(queue, (found[0], left, ids[left], ids[right], found[1]))

        for k in range(n - 1):
            offer(k)
        while queue:
            _, left, first, second, merged = heapq.heappop(queue)
            right = after[left]
            if right < 0 or ids[left] != first or ids[right] != second:
                continue
            ids[left], ids[right] = merged, -1
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [x for x in ids if x >= 0]

    def entries(self, text: str) -> list[tuple[bytes, str]]:
        """The entry of each word of a text, added tokens included."""
        found: list[tuple[bytes, str]] = []
        at = 0
        for match in self.added_pattern.finditer(text) if "<|" in text else ():
            found += self.plain(text[at : match.start()])
            token = match.group()
            found.append((np.array([self.added[token]], dtype="<u4").tobytes(), token))
            at = match.end()
        return found + self.plain(text[at:] if at else text)

    def plain(self, text: str) -> list[tuple[bytes, str]]:
        if UNUSUAL.search(text) is None:
            return list(map(self.words.__getitem__, PLAIN_WORDS.findall(text.lower())))
        normal = self.library.normalizer.normalize_str(text)
        return [self.pieces[piece] for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(ids for ids, _ in self.entries(text)), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as for a file without a decoder."""
        return " ".join(self.tokens[i] for i in ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, and of the decoded text."""
        entries = self.entries(text)
        ids = b"".join([x[0] for x in entries])
        decoded = " ".join([x[1] for x in entries])
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row: a narrow pass."""

    def work(ids: list, texts: list[str]) -> dict[str, list]:
        c = codec(path)
        encoded = [c.encode(text) for text in texts]
        return {"doc_id": ids, "ids": encoded, "decoded": [c.decode(x) for x in encoded]}

    return map_texts(docs, work, "doc_id long, ids array<long>, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: a narrow pass."""

    def work(ids: list, texts: list[str]) -> dict[str, list]:
        c = codec(path)
        n, first, second = zip(*map(c.digest, texts))
        return {"doc_id": ids, "n_tokens": list(n), "ids_sha256": list(first), "decoded_sha256": list(second)}

    return map_texts(docs, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
