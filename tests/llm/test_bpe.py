import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnflow.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def same(codec, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids, repr(text)
    decoded = library.decode(ids, skip_special_tokens=False)
    assert codec.decode(ids) == decoded
    raw = np.array(ids, dtype="<u4").tobytes()
    assert codec.digest(text) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "\n\t", "a", "Hello, world!!", "It's we'll THEY'RE x'S", "<|endoftext|>", "a<|startoftext|>b <|endoftext|> c<|x|>",
        "ÉÈÀ œuvre ß ñandú ¿qué? «oui» – — ‘a’ “b” … 5€", "a_b __ 12 3.5 ½ ² ⅷ", "ΣΑΣ Σ", "İstanbul ǅ ﬁ", "é Å 가", "日本語 中文 한국어 العربية",
        "\x1c\x1f\x85\xa0  x", "​﻿", "😀👍🏽", "x" * 700, "ab" * 3000, "lorem ipsum " * 500,
    ],
)
def test_equals_the_library(codec, library, text):
    same(codec, library, text)


def test_every_plain_character(codec, library):
    """No character of the plain path is treated in another way than by the library."""
    plain = [c for c in map(chr, range(0x3000)) if bpe.UNUSUAL.search(c) is None]
    assert len(plain) > 400
    for c in plain:
        same(codec, library, f"a{c}b {c} {c}{c}1{c}")


def test_random_texts(codec, library):
    rng = random.Random(5)
    letters = "abcdeéàçñß' .,!?_0123456789\n\tABCÉ|#<>-" + "½²ΣΩжя中́\xa0"
    for _ in range(300):
        same(codec, library, "".join(rng.choice(letters) for _ in range(rng.randrange(60))))


def test_heap_merges_as_the_scan_does(codec):
    rng = random.Random(6)
    for _ in range(200):
        word = bytes(rng.choice(b"aeionrst") for _ in range(rng.randrange(1, 300)))
        ids = [codec.letter_ids[b] for b in word[:-1]] + [codec.last_ids[word[-1]]]
        assert codec.scan(list(ids)) == codec.heap(list(ids))


def test_null_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "Hi you", 9), (3, "Hi you", 9), (None, "x", 9)], "doc_id long, text string, n_tokens int")
    rows = bpe.digest(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert bpe.encode(docs.limit(0), PATH).count() == 0
