import hashlib
import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tarnflow.llm import fingerprint as fp


def prose(rng, words):
    return " ".join("".join(rng.choice("aeionrstlm") for _ in range(rng.randint(1, 9))) for _ in range(words))


def test_labels_differ_between_neighbours_and_are_small():
    rng = np.random.default_rng(1)
    symbols = rng.integers(1, 1 << 63, 5000, dtype=np.uint64)
    first = np.zeros(5000, dtype=bool)
    first[0] = True
    labels = fp.labels_of(symbols, first)
    assert labels.max() < 6
    assert (labels[1:] != labels[:-1]).mean() > 0.999


def test_equal_substrings_share_interior_phrases():
    """A text moved to another offset keeps nearly all of its phrases."""
    rng = random.Random(2)
    text = prose(rng, 400)
    moved = prose(rng, 37) + text
    whole, sketch = fp.fingerprints([text, moved, prose(rng, 400), text])
    like = lambda a, b: fp.likeness((whole[a : a + 1], sketch[a : a + 1]), (whole[b : b + 1], sketch[b : b + 1]))[0]
    assert like(0, 1) > 0.7
    assert like(0, 2) < 0.1
    assert like(0, 3) == 1.0


def test_batches_do_not_matter():
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([0, 1, 3, 50, 300])) for _ in range(60)] + ["", "a", "aa", "a" * 5000, "ab" * 900, "\n\n", "日本語" * 40]
    together = fp.encode(*fp.fingerprints(texts))
    alone = [fp.encode(*fp.fingerprints([t]))[0] for t in texts]
    assert together == alone
    assert len(set(together)) == len(set(texts))


def plain_mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) % 2**64
    return x ^ x >> 31


def toss(own, left):
    """Twice the place of the lowest bit in which two numbers differ, plus the own bit there."""
    bit = next((k for k in range(64) if (own ^ left) >> k & 1), 0)
    return 2 * bit + (own >> bit & 1)


def plain_phrases(symbols):
    folded = []
    for symbol, run in itertools.groupby(symbols):
        n = len(list(run))
        folded.append(symbol if n == 1 else plain_mix(symbol ^ n << 40))
    labels = folded
    for _ in range(4):
        labels = [toss(x, labels[k - 1] if k else 0) for k, x in enumerate(labels)]
    starts = [k for k in range(len(folded)) if k == 0 or (k < len(folded) - 1 and labels[k - 1] < labels[k] > labels[k + 1])]
    return [plain_mix((sum(plain_mix((x + k * 0x9E3779B97F4A7C15) % 2**64) for k, x in enumerate(folded[a:b])) + b - a) % 2**64) for a, b in zip(starts, [*starts[1:], len(folded)])]


def plain_fingerprint(text):
    """Symbol by symbol, from the definition."""
    bins, symbols, level, name = [None] * 64, [ord(c) + 1 for c in text], 0, 0
    while symbols:
        level += 1
        symbols = plain_phrases(symbols)
        for x in symbols if level > 1 else []:
            value = plain_mix((x + level) % 2**64)
            least = (value >> 32) % 0xFFFFFFFF
            bins[value % 64] = least if bins[value % 64] is None else min(bins[value % 64], least)
        if len(symbols) == 1:
            name = plain_mix((symbols[0] + level) % 2**64)
            break
    return name, bins


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    either = [(x, y) for x, y in zip(a[1], b[1]) if (x, y) != (None, None)]
    return sum(x == y for x, y in either) / max(1, len(either))


def written(found):
    return f"{found[0]:016x}" + "".join("ffffffff" if x is None else f"{x:08x}" for x in found[1])


def brute(rows):
    order = lambda r: (r[0] is None, -(r[0] or 0), (xxhash.xxh64_intdigest(r[1] or "", 42) + 2**63) % 2**64)
    rows = sorted(rows, key=order)
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        a, b, c = map(plain_fingerprint, (text, new, following))
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), written(a), written(b), plain_likeness(a, b), plain_likeness(a, c)))
    return out


def test_parse_against_plain_parse():
    rng = random.Random(12)
    texts = [prose(rng, rng.choice([1, 2, 5, 40, 150])) for _ in range(40)] + ["", "a", "aa", "ab", "aba", "a" * 300, "ab" * 70, "日本語" * 9, "\n\n x"]
    whole, sketch = fp.fingerprints(texts)
    assert fp.encode(whole, sketch) == [written(plain_fingerprint(t)) for t in texts]


def test_very_long_texts():
    """Parsed to the root: unrelated texts of two million characters are not alike, near
    ones are."""
    rng = np.random.default_rng(13)
    text = lambda: "".join(map(chr, rng.integers(97, 123, 2_000_000)))
    a, b = text(), text()
    whole, sketch = fp.fingerprints([a, b, a[:1_000_000] + "!" + a[1_000_000:]])
    like = lambda x, y: fp.likeness((whole[x : x + 1], sketch[x : x + 1]), (whole[y : y + 1], sketch[y : y + 1]))[0]
    assert like(0, 1) == 0 and like(0, 2) > 0.9


def as_rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_successors_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(k * 3, prose(rng, rng.choice([0, 1, 20, 200]))) for k in range(150)] + [(30, "again"), (30, "again"), (30, None), (None, "no id"), (None, None), (5000, "é" * 301)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, part int, fingerprint string").repartition(5)
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(as_rows(fp.compare_edits(frame)), key=order) == sorted(brute(rows), key=order)


def test_ids_of_very_many_rows_are_spread(spark):
    """A third of the rows without id, and a third of one id."""
    rng = random.Random(5)
    rows = [(None, prose(rng, 4)) for _ in range(100)] + [(50, prose(rng, 5)) for _ in range(100)] + [(k, prose(rng, 6)) for k in range(100)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(as_rows(fp.compare_edits(frame)), key=order) == sorted(brute(rows), key=order)
    sizes = [r["n"] for r in fp.with_successors(frame).filter("NOT copy").groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 60


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert fp.compare_edits(spark.createDataFrame([], schema)).count() == 0
    (one,) = as_rows(fp.compare_edits(spark.createDataFrame([(1, "abcd")], schema)))
    assert one[2] == hashlib.sha256(b"abab").hexdigest() and one[6] == 1.0
    same = as_rows(fp.compare_edits(spark.createDataFrame([(1, "abc"), (1, "abc"), (1, "abc")], schema)))
    assert len(same) == 3 and {r[6] for r in same} == {1.0}


def test_likeness_does_not_depend_on_the_side_of_a_length():
    """A near copy is as near when the lengths lie on both sides of 400 characters."""
    rng = random.Random(6)
    near = {}
    for short, long in ((395, 405), (385, 395), (405, 415)):
        found = []
        for _ in range(40):
            text = prose(rng, 120)[:long]
            whole, sketch = fp.fingerprints([text[:short], text])
            found.append(fp.likeness((whole[:1], sketch[:1]), (whole[1:], sketch[1:]))[0])
        near[short] = np.mean(found)
    assert min(near.values()) > 0.8
    assert max(near.values()) - min(near.values()) < 0.1
