"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over the distinct words of a text and their six-letter beginnings, hashed into ``BUCKETS``. It sees confirmed toxic texts and unlabelled texts only. With the
class prior ``pi``, the risk of calling unlabelled text clean is corrected for the toxic share in it:

    risk = pi * mean_P loss(+) + max(0, mean_U loss(-) - pi * mean_P loss(-))

and where the corrected part turns negative the step goes against it, as the estimator's authors propose. Training is
full-batch Adam in numpy over at most about ``SAMPLE_TOXIC`` and ``SAMPLE_UNLABELLED`` texts (of repeated ids twice as many rows, of
each kind ``common.SAMPLE_BYTES``); buckets seen in fewer than
``LEAST`` toxic texts, or whose uses are toxic by less than ``SHARE`` as the prior and both samples say, keep weight
zero; the others stay at zero or above. The prior is the toxic share among all labelled rows outside the held-out fold.

Defined cases: null and empty texts have no words and get the sigmoid of the bias; repeated rows and ids are scored
row by row; an empty table gives an empty table; null labels are not learned from; without toxic examples the bias
alone says clean; other columns are left out; a text of any length is read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.word_features import mix, range_hashes

BUCKETS = 1 << 18
SAMPLE_TOXIC, SAMPLE_UNLABELLED, LEAST, SHARE = 4_000, 8_000, 2, 0.6
PREFIX = 6
EDGES = "\"'.,;:!?()[]{}<>*#$%&|-_"


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two buckets of each word: its own and that of its beginning."""
    bare = [w.strip(EDGES) for w in words]
    chars = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, bare), np.int64, len(bare))
    starts = np.cumsum(sizes) - sizes
    whole = range_hashes(chars, starts, starts + sizes)
    begin = mix(range_hashes(chars, starts, starts + np.minimum(sizes, PREFIX)) ^ np.uint64(PREFIX))
    at = lambda h: (h % np.uint64(BUCKETS)).astype(np.int64)
    return at(whole), at(begin)


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def text_buckets(text: str | None) -> np.ndarray:
    words = list(words_of(text))
    return np.unique(np.concatenate(word_buckets(words))) if words else np.zeros(0, np.int64)


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 150, rate: float = 0.1, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias."""
    if not toxic:
        return np.zeros(BUCKETS, np.float32), -4.0
    prior = min(max(prior, 1e-3), 0.5)
    seen = np.bincount(np.concatenate(toxic), minlength=BUCKETS)
    among = np.bincount(np.concatenate([*unlabelled, np.zeros(0, np.int64)]), minlength=BUCKETS)
    used = np.flatnonzero((seen >= min(LEAST, len(toxic))) & (prior * seen / len(toxic) >= SHARE * among / max(len(unlabelled), 1)))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    rows = [place[b][place[b] >= 0] for b in [*toxic, *unlabelled]]
    doc, feature = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    n_p, n_u = len(toxic), max(len(unlabelled), 1)
    positive = np.arange(len(rows)) < n_p
    w, bias = np.zeros(len(used) + 1), -2.0  # the last weight moves the bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[feature], len(rows)) + bias + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_clean = np.logaddexp(0, z)  # loss of calling it toxic-free
        clean_risk = as_clean[~positive].sum() / n_u - prior * as_clean[positive].mean()
        slope = np.where(positive, prior / n_p * (p - 1), 0.0)
        corrected = np.where(positive, -prior / n_p * p, p / n_u)
        slope = slope + corrected if clean_risk >= 0 else -corrected
        g = np.append(np.bincount(feature, slope[doc], len(used)), slope.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)  # words are evidence of toxicity or none
    out = np.zeros(BUCKETS, np.float32)
    out[used] = w[:-1]
    return out, float(bias + w[-1])


class WordWeights(dict):
    """The weight of each word, remembered by a worker process from task to task."""

    def __init__(self, weights: np.ndarray, bias: float, limit: int = 600_000):
        super().__init__()
        self.weights, self.bias, self.limit = weights, bias, limit

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        sets = [words_of(t) for t in texts]
        new = list(set().union(*sets).difference(self))
        if new:
            whole, begin = word_buckets(new)
            self.update(zip(new, (self.weights[whole] + self.weights[begin]).tolist(), strict=True))
        return np.array([sum(map(self.__getitem__, s)) for s in sets], float) + self.bias


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", n_toxic: int = SAMPLE_TOXIC, n_unlabelled: int = SAMPLE_UNLABELLED) -> tuple[np.ndarray, float]:
    common.small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & (common.fold(F.col("doc_id")) != 0))
    prior = known.agg(F.avg("label")).first()[0] or 0.0
    picked = common.bounded_sample(known.filter("label = 1").select("doc_id").distinct(), "doc_id", n_toxic)
    texts = docs.select("doc_id", "text")
    toxic = common.bounded_texts(texts.join(F.broadcast(picked), "doc_id"), 2 * n_toxic).withColumn("toxic", F.lit(True))
    others = common.bounded_sample(docs.select("doc_id").filter(common.fold(F.col("doc_id")) != 0), "doc_id", n_unlabelled).distinct()
    unlabelled = common.bounded_texts(texts.join(F.broadcast(others), "doc_id"), 2 * n_unlabelled).withColumn("toxic", F.lit(False))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_buckets(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], ["doc_id", "buckets", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = toxic.unionByName(unlabelled).mapInArrow(hashed, f"doc_id {kind}, buckets array<int>, toxic boolean").orderBy("doc_id", "toxic", "buckets").collect()
    arrays = lambda is_toxic: [np.array(r.buckets, np.int64) for r in rows if r.toxic is is_toxic]
    return fit(arrays(True), arrays(False), float(prior))


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """Rows (doc_id, score)."""
    common.small_batches(docs.sparkSession)
    held, key = docs.sparkSession.sparkContext.broadcast(weights), uuid.uuid4().hex  # one number a bucket

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.remembered(key, lambda: WordWeights(held.value, bias))
        for batch in batches:
            z = words.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, *train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
