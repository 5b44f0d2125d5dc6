"""Quality classifier by positive-unlabelled learning.

Trusted positives are the texts labelled good; every text that may teach, good
or bad, labelled or not, is the unlabelled web text. A small network on features
of the text alone minimises the non-negative unbiased risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with the logistic loss, so that its sigmoid estimates the chance of label 1. The
class prior is estimated from the data: a first classifier orders the texts, and
the least upper bound over all its thresholds of (share of unlabelled above) /
(share of held-out positives above) is the prior. Negative labels teach nothing.

The fit sees bounded samples, chosen by a hash of the id (``Settings.positives``
and ``Settings.unlabelled`` rows, about); scoring covers every whole text in one
narrow pass.

Defined cases: a null text is empty and has a score like any other; several
labels of one document count as 1 only if all are 1; labels without a document,
null labels and null ids teach nothing; without positives every score is the
uninformed 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import id_and_text, map_texts, remainder, remainder_column

SYMBOLS = "|!#$%&*<>@{}[]=_~^\\/+"
SHAPE = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})
RUN = re.compile(r"(.)\1+", re.DOTALL)


@dataclass(frozen=True)
class Settings:
    positives: int = 20_000
    unlabelled: int = 40_000
    #: Hashed word shapes.
    shapes: int = 96
    hidden: int = 16
    steps: int = 400
    batch: int = 4096
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7
    threshold: float = 0.7


def bucket_of(shape: str, buckets: int) -> int:
    return zlib.crc32(shape.encode("utf-8", "surrogatepass")) % buckets


known_bucket = lru_cache(maxsize=50_000)(bucket_of)


def shape_bucket(shape: str, buckets: int) -> int:
    """The bucket of a whole shape; only short ones are remembered."""
    return (known_bucket if len(shape) < 64 else bucket_of)(shape, buckets)


def features(text: str, shapes: int) -> np.ndarray:
    """Features of one whole text, each of bounded size."""
    words = text.split()
    n, size = len(words), len(text)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x]
    per, each = 1 / max(n, 1), 1 / max(size, 1)
    dense = [
        np.log1p(n) / 8,
        (size - text.count(" ")) * per / 10,
        len(counts) * per,
        max(counts.values(), default=0) * per,
        pairs / max(n - 1, 1),
        len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)) / 6,
        min(1.0, len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) * each),
        sum(map(str.isupper, words)) * per,
        sum(map(str.istitle, words)) * per,
        sum(map(str.isalpha, words)) * per,
        sum(map(str.isdigit, words)) * per,
        max(map(len, words), default=0) / 200 if n else 0.0,
        (text.count(".") + text.count("?")) * per,
        text.count(",") * per,
        *(min(1.0, text.count(c) * each * 10) for c in SYMBOLS),
        float(n < 10),
        float(n < 30),
    ]
    bag = np.zeros(shapes)
    for shape, count in Counter(RUN.sub(r"\1", text.translate(SHAPE)).split()).items():
        bag[shape_bucket(shape, shapes)] += count
    return np.concatenate([dense, np.sqrt(bag * per)])


@dataclass
class Network:
    """One hidden layer; ``forward`` gives the log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        hidden = np.tanh(x @ w1 + b1)
        return hidden @ w2 + b2[0], hidden

    def normal(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.mean) / self.scale, -6, 6)

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.normal(raw))[0], -30, 30)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(net: Network, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, negative part) of the unbiased risk over positives ``xp`` and
    unlabelled rows ``xu``; the risk is the sum, the negative part not below zero."""
    zp, zu = net.forward(xp)[0], net.forward(xu)[0]
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def gradients(net: Network, xp: np.ndarray, xu: np.ndarray, prior: float) -> list[np.ndarray]:
    """Of the risk by each weight; where the negative part has fallen below zero, of
    minus that part alone, which steps back."""
    x = np.concatenate([xp, xu])
    logit, hidden = net.forward(x)
    zp, zu = logit[: len(xp)], logit[len(xp) :]
    if risk(net, xp, xu, prior)[1] >= 0:
        gp = np.full(len(xp), -prior / len(xp))
        gu = sigmoid(zu) / len(xu)
    else:
        gp, gu = prior * sigmoid(zp) / len(xp), -sigmoid(zu) / len(xu)
    g = np.concatenate([gp, gu])
    back = np.outer(g, net.weights[2]) * (1 - hidden**2)
    return [x.T @ back, back.sum(axis=0), hidden.T @ g, np.array([g.sum()])]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, s: Settings) -> Network:
    """Minimise the non-negative risk by Adam over mini-batches of both samples."""
    rng = np.random.default_rng(s.seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    width = unlabelled.shape[1]
    net = Network(mean, scale, [rng.normal(0, width**-0.5, (width, s.hidden)), np.zeros(s.hidden), rng.normal(0, s.hidden**-0.5, s.hidden), np.zeros(1)])
    p, u = net.normal(positive), net.normal(unlabelled)
    first = [np.zeros_like(w) for w in net.weights]
    second = [np.zeros_like(w) for w in net.weights]
    for step in range(1, s.steps + 1):
        xp, xu = p[rng.integers(0, len(p), min(len(p), s.batch))], u[rng.integers(0, len(u), min(len(u), s.batch))]
        rate = s.rate * (1 - 0.9 * step / s.steps)
        for k, grad in enumerate(gradients(net, xp, xu, prior)):
            if k % 2 == 0:
                grad = grad + s.decay * net.weights[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            net.weights[k] = net.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Least upper bound of the share of positives, from scores of held-out
    positives and of unlabelled texts."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.9, 91)))
    above_p = 1 - np.searchsorted(p, cuts, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, side="left") / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network | None:
    """Fit on bounded samples of the rows that may teach (crc32 of the id, modulo 4, is not 2)."""
    s = settings
    spread = F.xxhash64("doc_id", F.lit(s.seed)).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(remainder_column(4) != 2)
    good = good.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").orderBy(F.xxhash64("doc_id", F.lit(s.seed)), "doc_id").limit(s.positives).select("doc_id")
    teaching = id_and_text(docs).filter("doc_id IS NOT NULL").filter(remainder_column(4) != 2)
    total = teaching.select("doc_id").count()
    share = min(1.0, s.unlabelled / max(total, 1))

    def work(ids: list, texts: list[str]) -> dict[str, list]:
        return {"doc_id": ids, "x": [features(text, s.shapes).tolist() for text in texts]}

    def sample(rows: DataFrame) -> np.ndarray:
        got = map_texts(rows, work, "doc_id long, x array<float>").toPandas().sort_values("doc_id")
        return np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), -1 if len(got) else 0)

    positive = sample(teaching.join(F.broadcast(good), "doc_id", "left_semi"))
    unlabelled = sample(teaching.filter(spread < share))
    if not len(positive) or not len(unlabelled):
        return None
    order = np.random.default_rng(s.seed).permutation(len(positive))
    held, taught = positive[order[: max(1, len(order) // 3)]], positive[order[len(order) // 3 :]]
    rough = fit(taught, unlabelled, 0.5, s)
    prior = class_prior(rough.score(held), rough.score(unlabelled))
    return fit(positive, unlabelled, prior, s)


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    network = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, settings))

    def work(ids: list, texts: list[str]) -> dict[str, list]:
        net = network.value
        scores = [0.5] * len(texts) if net is None else net.score(np.array([features(text, settings.shapes) for text in texts])).tolist()
        return {"doc_id": ids, "held_out": [remainder(k, 4) == 2 for k in ids], "score": scores, "predicted": [int(x >= settings.threshold) for x in scores]}

    return map_texts(docs, work, "doc_id long, held_out boolean, score double, predicted int")
