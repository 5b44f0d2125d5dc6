"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning is one distributed count: every partition adds up its n-gram buckets by
language, and the sums meet in one aggregate of at most languages x buckets rows.
Every language is learnt; the log-probabilities are collected and broadcast as one
matrix for each ``languages`` of them (64 KB a language). Scoring is a narrow pass
that sums matrix rows over each text's n-grams in numpy. The language is the one of
the highest full sum plus prior; only the reported score is tempered.

Defined cases: a text without a letter (or null) is ``und`` with score 0; ties go
to the first language in order of name; with no labelled row every text is
``und``; rows without language do not teach; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import keep_rows, map_texts, parts, remainder, remainder_column
from tarnflow.storage import materialize

UND = "und"
#: Characters that are scored or counted together: their n-grams stay in the cache.
PIECE_CHARS = 250_000
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    orders: tuple[int, ...] = (1, 2, 3)
    smoothing: float = 0.5
    #: A matrix holds so many languages at most; more take several matrices.
    languages: int = 200
    #: For the reported score, the sum and prior of a text of more n-grams are
    #: scaled down to so many, so that the score of a long text is not always one.
    evidence: float = 60.0


def buckets_of(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased texts, and the text's number for each of them.

    An n-gram never crosses from one text into another.
    """
    joined = "".join(f" {text.lower()} " for text in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter((len(text.lower()) + 2 for text in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    found, whose = [], []
    for order in s.orders:
        if len(points) < order:
            continue
        code = points[: len(points) - order + 1].astype(np.uint32)
        for k in range(1, order):
            code = code * np.uint32(0x01000193) + points[k : len(points) - order + 1 + k]
        code = (code ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        code ^= code >> np.uint32(15)
        first = owner[: len(code)]
        if order > 1:
            inside = first == owner[order - 1 :]
            code, first = code[inside], first[inside]
        found.append((code % np.uint32(s.buckets)).astype(np.int32))
        whose.append(first)
    return np.concatenate(found), np.concatenate(whose)


@dataclass
class Model:
    names: list[str]
    #: buckets x languages
    weights: np.ndarray
    prior: np.ndarray
    settings: Settings

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language and its tempered posterior for each text."""
        return predict([self], texts)[:2]


def predict(models: list[Model], texts: list[str]) -> tuple[list[str], list[float], list[float]]:
    """The language of each text, its tempered posterior and its posterior; the
    models hold different languages, in order of name."""
    every = [name for model in models for name in model.names]
    if not every or not texts:
        return [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    s = models[0].settings
    bucket, owner = buckets_of(texts, s)
    # sparse rows (text, bucket, count) times the matrices
    kind = np.int32 if len(texts) * s.buckets < 1 << 31 else np.int64
    cell = np.sort(owner.astype(kind) * kind(s.buckets) + bucket)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    count, cell = np.diff(np.r_[first, len(cell)]), cell[first]
    row, column = cell // s.buckets, cell % s.buckets
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    total = np.zeros((len(texts), len(every)))
    at = 0
    for model in models:
        upto = at + len(model.names)
        total[row[starts], at:upto] = np.add.reduceat(model.weights[column] * count[:, None], starts, axis=0)
        total[:, at:upto] += model.prior
        at = upto
    n = np.bincount(owner, minlength=len(texts))
    total -= total.max(axis=1, keepdims=True)
    best = total.argmax(axis=1)
    # the best language has the sum 0
    tempered = 1 / np.exp(total * (np.minimum(n, s.evidence) / np.maximum(n, 1))[:, None]).sum(axis=1)
    plain = 1 / np.exp(total).sum(axis=1)
    letters = [LETTER.search(text) is not None for text in texts]
    names = [every[k] if some else UND for k, some in zip(best, letters)]
    return names, *([float(x) if some else 0.0 for x, some in zip(scores, letters)] for scores in (tempered, plain))


def learn(docs: DataFrame, settings: Settings = Settings()) -> list[Model]:
    """Count n-grams by language over all rows of ``docs`` that have a ``lang``."""
    s = settings
    labelled = docs.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = {row["lang"]: row["n"] for row in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(rows)
    place = {name: k for k, name in enumerate(names)}
    if not names:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            renamed = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["doc_id", "text"])
            for langs, texts in parts(renamed, PIECE_CHARS):
                bucket, owner = buckets_of(texts, s)
                present, which = np.unique(np.array([place[x] for x in langs]), return_inverse=True)
                cells = np.bincount(which[owner] * s.buckets + bucket, minlength=len(present) * s.buckets)
                for k, part in zip(present.tolist(), cells.reshape(-1, s.buckets)):
                    if k in seen:
                        seen[k] += part
                    else:
                        seen[k] = part.copy()
        for k, total in seen.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k * s.buckets + used, type=pa.int64()), pa.array(total[used], type=pa.int64())], names=["cell", "n"])

    cells = labelled.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    if len(names) > s.languages:
        cells = materialize(cells, "cells")
    models = []
    for at in range(0, len(names), s.languages):
        some = names[at : at + s.languages]
        low, high = at * s.buckets, (at + len(some)) * s.buckets
        found = cells.filter(F.col("cell").between(low, high - 1)).toPandas()
        counts = np.zeros(len(some) * s.buckets)
        counts[found["cell"].to_numpy(dtype=np.int64) - low] = found["n"].to_numpy(dtype=np.float64)
        counts = counts.reshape(len(some), s.buckets) + s.smoothing
        weights = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)
        prior = np.log(np.array([rows[name] for name in some], dtype=np.float64) / sum(rows.values()))
        models.append(Model(some, np.ascontiguousarray(weights), prior, s))
    return models


def teaching(docs: DataFrame) -> DataFrame:
    """Rows that may teach: crc32 of the id, modulo 4, is not 2."""
    return docs.filter(remainder_column(4) != 2)


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The predicted language of every row; learnt from the rows that may teach."""
    models = [docs.sparkSession.sparkContext.broadcast(model) for model in learn(teaching(docs), settings)]

    def work(ids: list, texts: list[str]) -> dict[str, list]:
        names, scores, _ = predict([model.value for model in models], texts)
        return {"doc_id": ids, "held_out": [remainder(k, 4) == 2 for k in ids], "lang_pred": names, "score": scores}

    return map_texts(docs, work, "doc_id long, held_out boolean, lang_pred string, score double", PIECE_CHARS)


def keep_identified(docs: DataFrame, least: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without texts in no learnt language or with a posterior under ``least``."""
    models = [docs.sparkSession.sparkContext.broadcast(model) for model in learn(teaching(docs), settings)]

    def verdicts(_: list, texts: list[str]) -> list[bool]:
        names, _, scores = predict([model.value for model in models], texts)
        return [name != UND and score >= least for name, score in zip(names, scores)]

    return keep_rows(docs, verdicts, PIECE_CHARS)
