"""URL verdicts: rules first, gradient-boosted trees on lexical features for the rest.

Features of a url: lengths of url, host and path, path depth, labels of the host, digit ratio, entropy of its
characters, number of parameters, hyphens, and for the last one and two labels of the host and the first segment of the
path their share of the training urls and the share of those that is blocked. Trees are fit on the driver from a bounded sample of labelled urls
(``SAMPLE_ROWS``). While they are fit, the suffix figures of a url come from the other ``FOLDS`` - 1 folds of the sample,
so that no url sees its own label; figures are shares in both cases, and scoring uses those of the whole sample. In the
query the labels are the verdicts of the rules. Every url is scored in Arrow batches.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule, and features of an empty
url; repeated rows and ids are judged row by row; an empty table gives an empty table; without labelled urls, or
with one label only, the method answers that label (allow if none); other columns are left out; a url of any
length is read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: About how many labelled urls, at most, the trees are fit on: those whose ids have the smallest hashes.
SAMPLE_ROWS = 20_000
FOLDS = 5
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path as the url states them."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return df.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0))


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def suffixes(host: str, path: str) -> tuple[str, str, str]:
    """The last one and two labels of the host, and the first segment of the path."""
    labels = host.rsplit(".", 2)
    return labels[-1], ".".join(labels[-2:]), "/" + path[1:].split("/", 1)[0]


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    counts = np.array(list(Counter(url).values()), float)
    share = counts / max(len(url), 1)
    query = url.partition("#")[0].partition("?")[2]
    digits = sum(map(url.count, "0123456789"))
    return [len(url), len(host), len(path), path.count("/"), host.count(".") + 1 if host else 0, digits / max(len(url), 1), float(-(share * np.log2(share)).sum()), len([p for p in query.split("&") if p]), url.count("-"), float(url.startswith("https"))]


class Trees:
    """Gradient boosting with logistic loss on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth = rounds, depth, rate, bins, smooth
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [self._between(c) for c in x.T]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list = []
            self._grow(tree, binned, p - y, p * (1 - p), np.arange(len(y)), 0)
            self.trees.append(tree)
            score += self._walk(tree, binned)
        return self

    def _between(self, column: np.ndarray) -> np.ndarray:
        """At most bins - 1 cuts, halfway between neighbouring values, so that what is near a training value falls into its bin."""
        values = np.unique(column)
        picked = np.unique(np.searchsorted(values, np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")))
        picked = picked[picked + 1 < len(values)]
        return (values[picked] + values[picked + 1]) / 2

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def _grow(self, tree: list, binned, g, h, rows, depth: int) -> int:
        at, total_g, total_h = len(tree), g[rows].sum(), h[rows].sum()
        tree.append((-1, 0, -self.rate * total_g / (total_h + self.smooth), 0, 0))
        if depth == self.depth or len(rows) < 2:
            return at
        worth = lambda a, b: a * a / (b + self.smooth)
        best = (1e-6, -1, 0)
        for f in range(binned.shape[1]):
            left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], self.bins))
            left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], self.bins))
            gain = worth(left_g, left_h) + worth(total_g - left_g, total_h - left_h) - worth(total_g, total_h)
            b = int(gain[:-1].argmax())
            if gain[b] > best[0]:
                best = (float(gain[b]), f, b)
        if best[1] < 0:
            return at
        goes = binned[rows, best[1]] <= best[2]
        left = self._grow(tree, binned, g, h, rows[goes], depth + 1)
        right = self._grow(tree, binned, g, h, rows[~goes], depth + 1)
        tree[at] = (best[1], best[2], 0.0, left, right)
        return at

    def _walk(self, tree: list, binned: np.ndarray) -> np.ndarray:
        feature, cut, value, left, right = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(binned), int)
        for _ in range(self.depth):
            f = feature[at]
            down = np.where(binned[np.arange(len(at)), np.maximum(f, 0)] <= cut[at], left[at], right[at])
            at = np.where(f < 0, at, down)
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x) if self.trees else None
        return 1 / (1 + np.exp(-(self.base + sum((self._walk(t, binned) for t in self.trees), np.zeros(len(x))))))


class UrlModel:
    """Suffix statistics and trees; ``fit`` takes (url, host, path, blocked) rows."""

    def fit(self, rows: list[tuple[str | None, str, str, int]]) -> UrlModel:
        y = np.array([r[3] for r in rows], float)
        self.rate = float(y.mean()) if len(y) else 0.0
        self.figures = self.count(rows)
        self.trees = Trees()
        if 0 < self.rate < 1:
            folds = np.random.default_rng(5).permutation(len(rows)) % FOLDS
            x = np.zeros((len(rows), 16))
            for k in range(FOLDS):
                own = np.flatnonzero(folds == k)
                others = self.count([rows[i] for i in np.flatnonzero(folds != k)])
                x[own] = self.features([rows[i][:3] for i in own], others)
            self.trees.fit(x, y)
        else:
            self.trees.base = 30.0 if self.rate else -30.0
        return self

    @staticmethod
    def count(rows: list[tuple[str | None, str, str, int]]) -> tuple[int, Counter, Counter]:
        """Number of rows, and for each suffix how many rows and how many blocked ones have it."""
        seen: Counter = Counter()
        blocked: Counter = Counter()
        for _, host, path, label in rows:
            for s in set(suffixes(host, path)):
                seen[s] += 1
                blocked[s] += label
        return len(rows), seen, blocked

    def features(self, rows: list[tuple[str | None, str, str]], figures: tuple[int, Counter, Counter]) -> np.ndarray:
        total, seen, blocked = figures
        out = []
        for url, host, path in rows:
            x = lexical(url, host, path)
            for s in suffixes(host, path):
                x += [seen[s] / max(total, 1), (blocked[s] + 2 * self.rate) / (seen[s] + 2)]
            out.append(x)
        return np.array(out, float).reshape(len(rows), 16)

    def score(self, rows: list[tuple[str | None, str, str]]) -> np.ndarray:
        return self.trees.probability(self.features(rows, self.figures))


def train(labelled: DataFrame, id_col: str, url_col: str, label_col: str, limit: int = SAMPLE_ROWS) -> UrlModel:
    """Fit from about ``limit`` rows at most whose label (1: block) is not null."""
    rows = with_parts(labelled.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("label")).filter("label is not null"))
    picked = common.bounded_sample(rows, "id", limit).select("url", "host", "path", "label").collect()
    return UrlModel().fit(sorted((tuple(r) for r in picked), key=repr))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, model: UrlModel | None = None, limit: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (id, host, path, rule, verdict, score); labels for the trees are the rules' own verdicts unless a model is given."""
    common.small_batches(pages.sparkSession)
    rule, said = rule_columns(rules)
    base = with_parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))).withColumn("rule", rule).withColumn("said", said)
    if model is None:
        model = train(base.withColumn("label", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0)), "id", "url", "label", limit)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3, 4, 5)), pa.array(p, pa.float64())], ["id", "host", "path", "rule", "said", "score"])

    kind = pages.schema[id_col].dataType.simpleString()
    scored = base.mapInArrow(score, f"id {kind}, host string, path string, rule string, said string, score double")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
