"""Supervised subword embeddings for text quality.

A document is the average of learned vectors, one for each of its words and one for each character n-gram of those
words, found by hashing, and one for each word that repeats the word before it (the bigrams of a word with itself, pooled
in one vector that weighs as much as a whole word). A softmax layer over the two labels follows. Both are trained together by stochastic gradient
descent in numpy, on at most ``SAMPLE_DOCS`` labelled documents with their whole texts.

The average and the layer are linear, so at scoring time every distinct word has one number (what its vectors add to
the difference of the two outputs) and a count; a worker remembers them, and a text's score needs one look-up a word.

Defined cases: null and empty texts, and texts of white space, have no features and get the sigmoid of the bias;
repeated rows and ids are scored row by row; an empty table gives an empty table; rows whose label is null are not
learned from; without labels, or with one label only, the score is that label's (1 without any); other columns are
left out; a text of any length is read whole.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.word_features import subwords

#: About how many labelled documents, at most, are learned from: those whose ids have the smallest hashes. Of repeated ids about
#: twice as many rows, and of all about ``common.SAMPLE_BYTES`` of text.
SAMPLE_DOCS = 3_000
BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4)
#: What one pooled bigram counts for, in features: about those of a word.
REPEAT_WEIGHT = 16


class SubwordModel:
    def __init__(self, buckets: int = BUCKETS, dim: int = DIM, grams: tuple[int, ...] = GRAMS, seed: int = 7):
        self.buckets, self.dim, self.grams = buckets, dim, grams
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-0.5 / dim, 0.5 / dim, (buckets + 1, dim)).astype(np.float32)  # the last is the pooled bigram's
        self.out, self.bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
        self.rng = rng

    def fit(self, texts: list[str], labels: list[int], epochs: int = 3, batch: int = 32, rate: float = 0.5) -> SubwordModel:
        y = np.array(labels, int)
        if len(set(labels)) < 2:
            self.bias = np.array([0.0, 20.0 if not labels or labels[0] else -20.0], np.float32)
            return self
        steps, total = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = self.rng.permutation(len(y))
            for k in range(0, len(y), batch):
                rows = order[k : k + batch]
                self._step([texts[i] for i in rows], y[rows], rate * (1 - steps / total))
                steps += 1
        return self

    def _step(self, texts: list[str], y: np.ndarray, rate: float) -> None:
        number: dict[str, int] = {}
        docs, words, times, again = [], [], [], np.zeros(len(texts), np.float32)
        for d, text in enumerate(texts):
            parts = text.split()
            for w, n in Counter(parts).items():
                docs.append(d)
                words.append(number.setdefault(w, len(number)))
                times.append(n)
            again[d] = REPEAT_WEIGHT * sum(map(str.__eq__, parts, parts[1:]))
        if not number:
            return
        docs, words, times = np.array(docs), np.array(words), np.array(times, np.float32)
        features, counts = subwords(list(number), self.buckets, self.grams)
        starts = np.cumsum(counts) - counts
        word_vectors = np.add.reduceat(self.vectors[features], starts)
        sizes = np.bincount(docs, times * counts[words], len(texts)) + again
        share = times / sizes[docs]
        first = np.searchsorted(docs, np.arange(len(texts)))
        some = np.flatnonzero(sizes > 0)
        mean = np.zeros((len(texts), self.dim), np.float32)
        mean[some] = np.add.reduceat(word_vectors[words] * share[:, None], first[some])
        repeats = again / np.maximum(sizes, 1)
        mean += repeats[:, None] * self.vectors[-1]
        z = mean @ self.out.T + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        slope = (p @ self.out)[docs] * share[:, None]
        word_slope = np.stack([np.bincount(words, slope[:, j], len(number)) for j in range(self.dim)], axis=1)
        each = np.repeat(word_slope, counts, axis=0)
        touched, at = np.unique(features, return_inverse=True)
        for j in range(self.dim):  # the vectors of one batch move together, each by the sum over its documents
            self.vectors[touched, j] -= rate * np.bincount(at, each[:, j], len(touched)).astype(np.float32) * 10
        self.vectors[-1] -= rate * 10 * repeats @ (p @ self.out)
        self.out -= rate * p.T @ mean
        self.bias -= rate * p.mean(axis=0)

    def compact(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the difference of the outputs, and the difference of the biases."""
        return self.vectors @ (self.out[1] - self.out[0]), float(self.bias[1] - self.bias[0])


class WordScorer(dict):
    """Remembers, for each word, the sum of its features' values and their number."""

    def __init__(self, values: np.ndarray, grams: tuple[int, ...], limit: int = 100_000):
        super().__init__()
        self.values, self.grams, self.limit = values, grams, limit
        self.sums, self.counts, self.pending = np.zeros(0), np.zeros(0), []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.pending.append(word)
        return n

    def means(self, texts: list[str]) -> np.ndarray:
        """Mean value over all features of each text; 0 without any."""
        if len(self) > self.limit:
            self.clear()
            self.sums, self.counts = np.zeros(0), np.zeros(0)
        words, ends = [], []
        for t in texts:
            words += t.split()
            ends.append(len(words))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.pending:
            features, counts = subwords(self.pending, len(self.values) - 1, self.grams)
            self.sums = np.concatenate([self.sums, np.add.reduceat(self.values[features], np.cumsum(counts) - counts)])
            self.counts = np.concatenate([self.counts, counts])
            self.pending = []
        again = np.zeros(len(at))
        again[1:] = REPEAT_WEIGHT * (at[1:] == at[:-1])
        again[[e for e in [0, *ends] if e < len(at)]] = 0  # no text continues another
        total = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[[0, *ends]])
        return total(self.sums[at] + again * self.values[-1]) / np.maximum(total(self.counts[at] + again), 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE_DOCS) -> SubwordModel:
    """Learn from documents outside the held-out fold; repeated ids count as their rows say."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & (common.fold(F.col("doc_id")) != 0))
    picked = common.bounded_sample(known, "doc_id", limit)
    texts = common.bounded_texts(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), 2 * limit)
    rows = texts.orderBy("doc_id", "label", "text").select("text", "label").collect()
    return SubwordModel().fit([r.text or "" for r in rows], [r.label for r in rows])


def score(docs: DataFrame, model: SubwordModel, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id unless given) of every row, and in ``out`` the probability of label 1."""
    keep = keep or ["doc_id"]
    common.small_batches(docs.sparkSession)
    values, bias = model.compact()
    held = docs.sparkSession.sparkContext.broadcast(values)  # one number a bucket, whatever the input
    grams, key = model.grams, uuid.uuid4().hex

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = common.remembered(key, lambda: WordScorer(held.value, grams))
        for batch in batches:
            z = scorer.means([t or "" for t in batch.column(len(keep)).to_pylist()]) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))), pa.float64())], [*keep, out])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("text to score")).mapInArrow(rate, f"{schema}, `{out}` double")


def accepted(docs: DataFrame, model: SubwordModel, least: float) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns."""
    out = common.free_name(docs, "quality score")
    return score(docs, model, docs.columns, out).filter(F.col(out) >= least).select(*docs.columns)


THRESHOLD = 0.3


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
