import base64
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from tarnflow.llm import quality_classifier as qc
from tarnflow.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    marked = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:k] for k, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), failed


def test_counts_against_plain_python():
    rng = random.Random(1)
    rules = qr.Rules(qr.Bands())
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "é ", "# ", "\n", "\t", "\x1f", "\xa0", "a b c d e f ", "$|<>&%* ", " "]) for _ in range(rng.randrange(60)))
        assert rules.measure(text)[:6] == plain_counts(text)


def test_bands():
    rng = random.Random(2)
    rules = qr.Rules(qr.Bands())
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(900))
    noise = " ".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(60))
    varied = " ".join(f"item{k % 7} goes to place{k}" for k in range(900))
    assert rules.measure(prose)[6]
    assert not rules.measure(noise)[5] and not rules.measure(noise)[6]
    assert not rules.measure(varied)[5] and not rules.measure(varied)[6]
    # one repetitive part of a good text is found by the chunks
    assert not rules.measure(prose[:4000] + " ".join(f"x{k} y" for k in range(1500)))[6]


def test_rule_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "word " * 300_000)]
    frame = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n_words int, kept string")
    got = qr.measure_quality(frame).collect()
    assert len(got) == 6 and not any(r.kept for r in got)
    assert {r.n_words for r in got} == {0, 1, 2, 300_000}
    assert qr.keep_quality(frame).columns == frame.columns
    assert qr.keep_quality(frame).count() == 0 and qr.measure_quality(frame.limit(0)).count() == 0


def labelled(seed, n):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(5, 80))]
        text = " ".join(words) + "." if good else " | ".join(words).upper() + "!!!"
        docs.append((k, text))
        if rng.random() < 0.5:
            labels.append((k, int(good), 0))
    return docs, labels, {k: t.endswith(".") for k, t in docs}


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(3, 1200)
    docs += [(5000, None), (5001, ""), (None, "x"), docs[0]]
    frame = spark.createDataFrame([(a, b, "x", 2.0) for a, b in docs], "doc_id long, text string, quality string, score double")
    marks = spark.createDataFrame([*labels, (1, None, None), (None, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    got = qc.score(frame, marks, qc.Settings(steps=150)).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(bool(r.predicted) == truth[r.doc_id] for r in held) > 0.95 * len(held)


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in qc.score(frame, none).collect()] == [0.5, 0.5]
    assert qc.score(frame.limit(0), none).count() == 0


def test_class_prior():
    rng = np.random.default_rng(5)
    positive = rng.normal(2, 1, 4000)
    for prior in (0.3, 0.6, 0.85):
        n = int(8000 * prior)
        unlabelled = np.r_[rng.normal(2, 1, n), rng.normal(-2, 1, 8000 - n)]
        assert qc.class_prior(positive, unlabelled) == pytest.approx(prior, abs=0.06)


def test_verdict_against_plain_rules():
    """The bands from the definition, one text at a time."""
    bands = qr.Bands()
    rng = random.Random(11)
    ratio = lambda raw: len(raw) / len(zstandard.ZstdCompressor(level=bands.level).compress(raw))
    kinds = [lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n)), lambda n: " ".join(f"item{k % 7} at place{k}" for k in range(n)), lambda n: base64.b64encode(rng.randbytes(4 * n)).decode(), lambda n: "é ü ñ " * n]
    seen = set()
    for _ in range(150):
        text = " ".join(rng.choice(kinds)(rng.choice([3, 12, 60, 400])) for _ in range(rng.randint(1, 4)))
        raw = text.encode()
        low, high = next(((a, b) for least, a, b in reversed(bands.whole) if len(raw) >= least), (0, 1e9))
        parts = [raw[k : k + 2048] for k in range(0, len(raw), 2048)]
        ratios = [ratio(x) for x in parts if len(x) >= 1024]
        good = not plain_counts(text)[5] and low <= ratio(raw) <= high and sum(not 1.4 <= x <= 4.0 for x in ratios) <= len(ratios) / 4
        assert qr.Rules(bands).measure(text)[6] == good
        seen.add(good)
    assert seen == {True, False}


def network(rng, width, hidden=5):
    return qc.Network(np.zeros(width), np.ones(width), [rng.normal(0, 0.7, (width, hidden)), rng.normal(0, 0.3, hidden), rng.normal(0, 0.7, hidden), rng.normal(0, 0.3, 1)])


def test_risk_against_one_text_after_the_other():
    rng = np.random.default_rng(3)
    for prior in (0.2, 0.7, 0.95):
        net, xp, xu = network(rng, 4), rng.normal(0.5, 1, (30, 4)), rng.normal(-0.2, 1, (50, 4))
        w1, b1, w2, b2 = net.weights
        odds = lambda x: sum(w2[h] * math.tanh(sum(x[i] * w1[i, h] for i in range(4)) + b1[h]) for h in range(5)) + b2[0]  # noqa: B023, E731
        loss = lambda z: math.log(1 + math.exp(-z))
        positive = prior * sum(loss(odds(x)) for x in xp) / 30
        negative = sum(loss(-odds(x)) for x in xu) / 50 - prior * sum(loss(-odds(x)) for x in xp) / 30
        assert qc.risk(net, xp, xu, prior) == pytest.approx((positive, negative))


def test_gradients_against_differences():
    """Of the whole risk, or, where its negative part is below zero, of minus that part."""
    rng = np.random.default_rng(4)
    signs = set()
    for shift in (0.0, -6.0):
        net, xp, xu = network(rng, 4), rng.normal(2, 1, (30, 4)), rng.normal(-2, 1, (50, 4))
        net.weights[3] = net.weights[3] + shift * (-1)
        xu = xp[:20] if shift else xu
        prior = 0.95 if shift else 0.4
        below = qc.risk(net, xp, xu, prior)[1] < 0
        if shift and not below:
            xu = xp[np.argsort(net.forward(xp)[0])[:8]]
            below = qc.risk(net, xp, xu, prior)[1] < 0
        signs.add(below)
        value = lambda: -qc.risk(net, xp, xu, prior)[1] if below else sum(qc.risk(net, xp, xu, prior))  # noqa: B023, E731
        for w, grad in zip(net.weights, qc.gradients(net, xp, xu, prior)):
            for at in np.ndindex(w.shape):
                old = w[at]
                w[at] = old + 1e-6
                up = value()
                w[at] = old - 1e-6
                down = value()
                w[at] = old
                assert grad[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    assert signs == {True, False}


def test_whole_shapes_count():
    """Words that differ behind their 24th character have different features."""
    assert qc.shape_bucket("aA0" * 30, 1 << 20) != qc.shape_bucket("aA0" * 31, 1 << 20)
    a, b = ("Zz0" * 12 + end for end in ("x", "x9"))
    assert (qc.features(a, 4096) != qc.features(b, 4096)).sum() >= 2
    assert len(qc.features("x1" * 2_000_000, 96)) == len(qc.features("", 96))
