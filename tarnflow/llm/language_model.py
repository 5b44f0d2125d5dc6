"""Language-model scores: a gated recurrent network trained on the corpus itself.

1. Every word of every training document is counted (partial sums in each task,
   one aggregate). The counts are the model's unigram part and the base score.
2. The network of :mod:`gru` learns the most frequent words; all others are one
   class, within which a word has the chance (c + 1) / (sum c + number + 1), so
   the probabilities of all words and of one unknown word sum to one. Each task
   trains on its own documents from the broadcast weights by truncated
   backpropagation, and the weights are averaged by tokens, level by level, after
   each of ``rounds`` disjoint shares of the documents. Every training document
   takes part once; work and gathered bytes grow with the corpus.
3. A narrow pass scores whole documents with the state carried from the first
   word to the end. Words beyond the broadcast head of the counts (a fixed
   number) go to an equi-join with all counts and are added up by document.

Tokens: words without ASCII white space, A-Z in lower case, then one end.
Training documents: crc32 of the id, modulo 7, is not 2.

Defined cases: a null or empty text is the end alone; rows that repeat an id and
text have equal scores; a null id counts as empty text for the fold; without
training documents every word is unknown; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import gru
from tarnflow.llm.common import arrow_schema, id_and_text, most_frequent, parts, remainder_column, to_batch
from tarnflow.storage import materialize

#: Stands for the end of a text among the counted words; no word has a space.
END = b" "


@dataclass(frozen=True)
class Settings:
    shape: gru.Shape = field(default_factory=gru.Shape)
    #: Most frequent words whose counts are broadcast.
    head: int = 1 << 18
    folds: int = 7
    held: int = 2
    rounds: int = 2
    #: Rows of weights that meet in one task, or on the driver.
    fan_in: int = 8
    #: Distinct words that a task counts before it hands them on.
    flush: int = 400_000
    #: Characters that stand in lanes together.
    batch_chars: int = 6_000_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def training(docs: DataFrame, s: Settings) -> DataFrame:
    return id_and_text(docs).filter(remainder_column(s.folds) != s.held)


def word_counts(docs: DataFrame, s: Settings) -> DataFrame:
    """``word, c`` over all training documents, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.binary()), pa.array(list(counts.values()), type=pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for _, texts in parts(batch):
                for text in texts:
                    counts.update(words_of(text))
                counts[END] += len(texts)
                if len(counts) > s.flush:
                    yield flush()
        if counts:
            yield flush()

    return training(docs, s).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Model:
    settings: Settings
    #: Most frequent words, the end left out, in order of frequency.
    head: list[bytes]
    counts: np.ndarray
    weights: gru.Weights
    tokens: int
    distinct: int
    rest_tokens: int
    rest_distinct: int
    ends: int
    place: dict[bytes, int] | None = None
    #: The same of the network's words alone, as its ids.
    own: dict[bytes, int] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": None, "own": None}  # rebuilt by each worker

    def lookup(self) -> dict[bytes, int]:
        if self.place is None:
            self.place = {word: k for k, word in enumerate(self.head)}
        return self.place

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the head, or -1."""
        return np.fromiter(map(self.lookup().get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        """The network's id of each word, without its place in the whole head."""
        last = self.settings.shape.vocabulary
        if self.own is None:
            self.own = {word: k for k, word in enumerate(self.head[: last - 1], 1)}
        return np.fromiter(map(self.own.get, words, repeat(last)), dtype=np.int32, count=len(words))

    def ids(self, ranks: np.ndarray) -> np.ndarray:
        """The network's id of each word: 1 and on, or that of all others."""
        last = self.settings.shape.vocabulary
        return np.where((ranks >= 0) & (ranks < last - 1), ranks + 1, last).astype(np.int32)


def count(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, Model]:
    """All word counts, those beyond the head, and an untrained model with the
    plain frequencies."""
    vocabulary = materialize(word_counts(docs, s), "words")
    total = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("word") == F.lit(END), F.col("c"))).alias("ends")).first()
    tokens, distinct, ends = total["n"] or 0, total["v"], total["ends"] or 0
    frequent, rare = most_frequent(vocabulary.filter(F.col("word") != F.lit(END)), "c", s.head)
    head = frequent.toPandas().sort_values(["c", "word"], ascending=[False, True])
    words, counts = [bytes(w) for w in head["word"]], head["c"].to_numpy(dtype=np.int64)
    known = s.shape.vocabulary - 1
    rest_tokens = tokens - ends - int(counts[:known].sum())
    plain = np.zeros(s.shape.vocabulary + 1)
    plain[0], plain[-1] = ends, rest_tokens
    plain[1 : 1 + min(known, len(counts))] = counts[:known]
    model = Model(s, words, counts, gru.initial(s.shape, plain), tokens, distinct, rest_tokens, max(0, distinct - (ends > 0) - min(known, len(words))), ends)
    return vocabulary, rare, model


def train(docs: DataFrame, model: Model) -> gru.Weights:
    """Averaged weights after every round."""
    s = model.settings
    spark = docs.sparkSession
    share = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(11)), F.lit(s.rounds))
    kinds = arrow_schema(spark, "tokens double, w binary")
    shape = s.shape
    for turn in range(s.rounds):
        sent = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model = sent.value
            trainer = None
            for batch in batches:
                for _, texts in parts(batch, s.batch_chars):
                    trainer = trainer or gru.Trainer(model.weights, shape)
                    trainer.learn([model.ids_of(words_of(text)) for text in texts])
            if trainer:
                yield to_batch({"tokens": [float(trainer.tokens)], "w": [gru.pack(trainer.w, shape)]}, kinds)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, total = 0.0, None
            for batch in batches:
                for n, raw in zip(batch.column("tokens").to_pylist(), batch.column("w").to_pylist()):
                    part = np.frombuffer(raw, dtype=np.float32) * np.float64(n)
                    tokens, total = tokens + n, part if total is None else total + part
            if total is not None:
                yield to_batch({"tokens": [tokens], "w": [(total / tokens).astype(np.float32).tobytes()]}, kinds)

        rows = training(docs, s).filter(share == turn)
        trained = rows.mapInArrow(learn, "tokens double, w binary")
        left = rows.rdd.getNumPartitions()
        while left > s.fan_in:
            left = -(-left // s.fan_in)
            trained = trained.repartition(left).mapInArrow(add, "tokens double, w binary")
        found = trained.collect()  # at most fan_in rows
        if found:
            tokens = np.array([row["tokens"] for row in found])
            parts_of = np.stack([np.frombuffer(row["w"], dtype=np.float32) for row in found])
            model.weights = gru.unpack((tokens @ parts_of / tokens.sum()).astype(np.float32), shape)
    return model.weights


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    s = settings
    _, rare, model = count(docs, s)
    model.weights = train(docs, model)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base_log, rest_log = np.log10(model.tokens + model.distinct + 1), np.log10(model.rest_tokens + model.rest_distinct + 1)
    schema = "doc_id long, text_hash long, word binary, tf long, n_tokens long, n_known long, base double, score double"
    kinds = arrow_schema(docs.sparkSession, schema)
    known = s.shape.vocabulary - 1

    def table(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        logs = np.log10(model.counts + 1.0)
        end = np.log10(model.ends + 1.0)
        for batch in batches:
            for ids, texts in parts(batch, s.batch_chars):
                sizes, ranks, missing, times, distinct = [], [], [], [], []
                for text in texts:
                    words = words_of(text)
                    at = model.ranks(words)
                    others = Counter(words[k] for k in np.flatnonzero(at < 0).tolist())
                    sizes.append(len(words))
                    ranks.append(at)
                    missing += others
                    times += others.values()
                    distinct.append(len(others))
                at = np.concatenate(ranks)
                network = np.split(model.ids(at), np.cumsum(sizes)[:-1])
                owner = np.repeat(np.arange(len(texts)), sizes)
                sums = lambda chosen: (np.bincount(owner[chosen], minlength=len(texts)), np.bincount(owner[chosen], logs[at[chosen]], len(texts)))
                (found, base), (rest, rest_logs) = sums(at >= 0), sums(at >= known)
                scores = gru.score(model.weights, network, s.shape) / np.log(10) + rest_logs - rest * rest_log
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(text) - (1 << 63) for text in texts), dtype=np.int64, count=len(texts))
                numbers = pa.array(ids, type=pa.int64()), pa.array(hashes)
                yield table(len(texts), doc_id=numbers[0], text_hash=numbers[1], n_tokens=np.array(sizes) + 1, n_known=found + (model.ends > 0), base=base + end - (found + 1) * base_log, score=scores)
                if missing:
                    of = pa.array(np.repeat(np.arange(len(texts)), distinct))
                    yield table(len(missing), doc_id=numbers[0].take(of), text_hash=numbers[1].take(of), word=missing, tf=times)

    scored = materialize(id_and_text(docs).mapInArrow(run, schema), "scores")
    tail = scored.filter("word IS NOT NULL").select("doc_id", "text_hash", "word", "tf").join(rare, "word", "left")
    zero, none = F.lit(0).cast("long"), F.lit(None)
    tail = tail.select(
        "doc_id", "text_hash", zero.alias("copies"), none.cast("long").alias("n_tokens"), none.cast("long").alias("n_known"), none.cast("double").alias("base"), none.cast("double").alias("score"),
        F.col("tf").alias("n"), (F.col("tf") * F.log10(F.coalesce("c", zero) + 1.0)).alias("log"), F.when(F.col("c") > 0, F.col("tf")).otherwise(zero).alias("seen"),
    )
    whole = scored.filter("word IS NULL").select("doc_id", "text_hash", F.lit(1).cast("long").alias("copies"), "n_tokens", "n_known", "base", "score", zero.alias("n"), F.lit(0.0).alias("log"), zero.alias("seen"))
    summed = whole.union(tail).groupBy("doc_id", "text_hash").agg(*(F.sum(c).alias(c) for c in ("copies", "n", "log", "seen")), *(F.max(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    held = remainder_column(s.folds) == s.held
    rows = summed.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + (F.col("seen") / F.col("copies")).cast("long")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + (F.col("log") - F.col("n") * F.lit(float(base_log))) / F.col("copies")).alias("base_score"),
        (F.col("score") + (F.col("log") - F.col("n") * F.lit(float(rest_log))) / F.col("copies")).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    return rows.drop("copy")
