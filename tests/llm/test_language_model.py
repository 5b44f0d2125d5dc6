import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnflow.llm import gru
from tarnflow.llm import language_model as lm

SMALL = gru.Shape(vocabulary=11, class_size=4, hidden=5)


def weights(seed=0):
    rng = np.random.default_rng(seed)
    w = gru.initial(SMALL, rng.integers(1, 50, 12).astype(float), seed)
    return {k: (v + rng.normal(0, 0.3, v.shape) * (v > -30)).astype(np.float32) for k, v in w.items()}


def plain_score(w, doc):
    """One document, one word at a time, by the written formulas."""
    size, total = SMALL.hidden, 0.0
    h, last = np.zeros(size), 0
    sig = lambda x: 1 / (1 + np.exp(-x))
    for word in [*doc, 0]:
        x, a = w["inputs"][last].astype(float), h @ w["recur"]
        z, r = sig(x[:size] + a[:size]), sig(x[size : 2 * size] + a[size : 2 * size])
        c = np.tanh(x[2 * size :] + r * a[2 * size :])
        h = (1 - z) * c + z * h
        classes = np.exp(h @ w["to_class"] + w["class_bias"])
        g = SMALL.classes if word == SMALL.vocabulary else word // SMALL.class_size
        total += math.log(classes[g] / classes.sum())
        if word < SMALL.vocabulary:
            part = slice(g * SMALL.class_size, (g + 1) * SMALL.class_size)
            words = np.exp(w["to_word"][part] @ h + w["word_bias"][part])
            total += math.log(words[word - part.start] / words.sum())
        last = word
    return total


def some_docs(n=23):
    rng = np.random.default_rng(4)
    return [rng.integers(1, 12, rng.integers(0, 30)).astype(np.int32) for _ in range(n)] + [np.empty(0, dtype=np.int32)]


def test_state_is_carried_through_whole_documents():
    w, docs = weights(), some_docs()
    expected = [plain_score(w, d.tolist()) for d in docs]
    for lanes, window in ((1, 3), (4, 7), (64, 64)):
        assert np.allclose(gru.score(w, docs, SMALL, lanes, window), expected, atol=1e-3)


def test_gradients_against_differences():
    w = {k: v.astype(np.float64) for k, v in weights(2).items()}
    lanes = gru.lanes_of(some_docs(9), 4)
    cut = [[x[t, : lanes.active[t]] for t in range(12)] for x in (lanes.inputs, lanes.targets, lanes.starts)]
    h = np.zeros((4, SMALL.hidden))
    loss = lambda: gru.gradients(w, h, *cut, SMALL)[0]
    grad = gru.gradients(w, h, *cut, SMALL)[1]
    dense = {k: grad[k] for k in ("recur", "to_class", "class_bias")}
    dense["inputs"] = np.zeros_like(w["inputs"])
    dense["inputs"][grad["inputs"][0]] = grad["inputs"][1]
    for name in ("to_word", "word_bias"):
        dense[name] = np.zeros_like(w[name])
        for g, value in grad[name].items():
            dense[name][g * 4 : g * 4 + 4] = value
    rng = np.random.default_rng(1)
    for name, value in dense.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in value.shape)
            keep = w[name][at]
            w[name][at] = keep + 1e-4
            up = loss()
            w[name][at] = keep - 1e-4
            down = loss()
            w[name][at] = keep
            assert value[at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-2), name


def corpus(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        stem = rng.choice("ab")
        rows.append((k, " ".join(f"{stem}{min(int(rng.expovariate(0.12)), 60)}" + rng.choice(["", "", "!"]) for _ in range(rng.choice([0, 1, 6, 40, 90]))).upper()))
    return rows + [(900, None), (901, ""), (902, "never seen words here"), rows[3], rows[3], (None, "a1 b2"), (None, None)]


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7


def test_counts_and_base_scores(spark):
    rows = corpus(1)
    s = lm.Settings(shape=gru.Shape(vocabulary=20, class_size=4, hidden=6), head=30, flush=25)
    frame = spark.createDataFrame([(a, b, 3, 0.5) for a, b in rows], "doc_id long, text string, tf int, score double").repartition(4)
    got = sorted((tuple(r) for r in lm.score(frame, s).collect()), key=str)
    counts = Counter()
    for doc_id, text in rows:
        if fold(doc_id) != 2:
            counts.update((text or "").lower().split() + [" "])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for doc_id, text in rows:
        words = (text or "").lower().split() + [" "]
        expected.append((doc_id, fold(doc_id) == 2, len(words), sum(w in counts for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)))
    expected.sort(key=str)
    assert len(got) == len(expected)
    by_id = {}
    for g in got:
        by_id.setdefault((g[0], g[2]), []).append(g)
    for e in expected:
        match = by_id[e[0], e[2]][0]
        assert match[:5] == e[:5]
        assert match[5] == pytest.approx(e[5], abs=1e-6)
    held = [g for g in got if g[1] and g[2] > 5]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)
    copies = [g for g in got if g[0] == 3]
    assert len(copies) == 3 and len({round(g[6], 6) for g in copies}) == 1


def test_probabilities_sum_to_one(spark):
    """Over every known word, an unknown one and the end, as a first token."""
    rows = [(k, text) for k, text in corpus(2, 60) if text]
    s = lm.Settings(shape=gru.Shape(vocabulary=9, class_size=4, hidden=4), head=15)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary, _, model = lm.count(frame, s)
    model.weights = lm.train(frame, model)
    w, last = model.weights, s.shape.vocabulary
    first = gru.step(w, np.zeros((1, 4), dtype=np.float32), w["inputs"][[0]], 4)[-1]
    chance = np.exp(gru.log_softmax(first @ w["to_class"] + w["class_bias"]))[0]
    known = {bytes(r["word"]): r["c"] for r in vocabulary.collect()}
    rest = sorted((c for word, c in known.items() if word != lm.END and word not in model.head[: last - 1]), reverse=True)
    assert sum(rest) == model.rest_tokens and len(rest) == model.rest_distinct
    inside = (sum(c + 1 for c in rest) + 1) / (model.rest_tokens + model.rest_distinct + 1)
    assert inside == pytest.approx(1)
    assert chance.sum() == pytest.approx(1, abs=1e-5)
    assert lm.score(frame.limit(0), s).count() == 0


class Plain(gru.Trainer):
    """Updates each class on its own, and counts the updates."""

    calls = 0

    def update(self, name, at, grad):
        self.calls += 1
        super().update(name, at, grad)

    def update_classes(self, name, grads, scale):
        for g, grad in grads.items():
            super().update(name, slice(g * 4, g * 4 + 4), grad * scale)


class Counted(Plain):
    update_classes = getattr(gru.Trainer, "update_classes", None)


def test_a_window_updates_all_classes_at_once():
    docs = [np.array(d.tolist() * 40, dtype=np.int32) for d in some_docs()]
    w = weights(3)
    w["to_word"] *= 8  # some gradients are long enough to be cut
    plain, counted = Plain(w, SMALL, lanes=8), Counted(w, SMALL, lanes=8)
    plain.learn(docs)
    counted.learn(docs)
    windows = -(-len(gru.lanes_of(docs, 8).active) // 16)
    assert counted.calls <= 4 * windows
    for name in w:
        assert np.allclose(plain.w[name], counted.w[name], atol=2e-3), name


def test_sums_of_long_and_short_runs():
    rng = np.random.default_rng(6)
    first = np.r_[0, np.cumsum([1, 40, 2, 32, 31, 500])]
    x = rng.normal(size=(first[-1] + 3, 5))
    assert np.allclose(gru.sums_of(x, first), np.add.reduceat(x, first, axis=0))


def test_training_needs_the_words_of_the_network_only():
    s = lm.Settings(shape=gru.Shape(vocabulary=4, class_size=2, hidden=3))
    model = lm.Model(s, [b"a", b"b", b"c", b"d", b"e"], np.arange(5, 0, -1), {}, 15, 6, 0, 0, 1)
    words = [b"e", b"a", b"zz", b"c", b"d", b"b"]
    assert model.ids_of(words).tolist() == model.ids(model.ranks(words)).tolist() == [4, 1, 4, 3, 4, 2]
    assert len(model.own) == 3
