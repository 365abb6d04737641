"""Benchmark passages in documents, by SimHash over item-sized windows.

Every benchmark item is one fingerprint: 64 bits, each the sign of the weighted votes of its five-word shingles' hashes.
A shingle weighs ``1 / (items that hold it)``, or 1 if no item does. Windows of a document as long as an item are
fingerprinted the same way. Fingerprints are cut into eight blocks; the index of each block lists the items by the
block's value, and looking up all values within ``BLOCK_RADIUS`` bits of a window's block finds every item within
``8 * (BLOCK_RADIUS + 1) - 1`` bits of the window's fingerprint, since more bits cannot be spread over eight blocks
without leaving one of them within the radius. Candidates are verified by exact weighted Jaccard similarity.

Windows without a single shingle of the item's size class have similarity zero, so only those with one are
fingerprinted; that is exact, and leaves most documents after one look at their shingles. For the same reason only items that
share a shingle with the document are looked up, and windows go by parts of at most ``MOST_CELLS`` windows times eight items.

The benchmark is collected and sent to every task; it must have at most ``MOST_ITEMS`` items and ``MOST_CHARS`` characters,
else the call raises an error, since cutting it would lose passages.

Defined cases: null and empty texts and items have no shingles and match nothing; texts and items of one to four words
are one shingle of all their words; repeated items and item ids are matched row by row and reported once an id;
repeated document rows give their matches once each; an empty documents or benchmark table gives no match; other
columns are left out; a text of any length is scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.ngram_join import shingle_rows

THRESHOLD = 0.8
BLOCK_RADIUS = 2
MOST_ITEMS, MOST_CHARS = 100_000, 100_000_000
MOST_CELLS = 1 << 20


def votes(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 votes, +1 or -1, for each hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def signs(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 sums as fingerprints; a tie is a zero bit."""
    return np.packbits(sums > 1e-4, axis=1, bitorder="little").view("<u8").ravel()


class Benchmark:
    """The items' shingles, weights, fingerprints and block indexes."""

    def __init__(self, ids: list, texts: list[str | None], radius: int = BLOCK_RADIUS):
        self.ids, rows = ids, shingle_rows(texts)
        self.sets = [np.unique(r) for r in rows]
        pool = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        self.known, counts = np.unique(pool, return_counts=True)
        self.weight = 1.0 / counts
        self.lengths = np.array([len(r) for r in rows], int)  # shingles, with repeats
        self.prints = np.array([signs((votes(r) * self.weigh(r)[:, None]).sum(axis=0)[None])[0] if len(r) else 0 for r in rows], np.uint64)
        near = [0] + [sum(1 << b for b in c) for k in range(1, radius + 1) for c in combinations(range(8), k)]
        self.near = np.array(near, np.uint8)
        self.by_length = {int(n): np.flatnonzero(self.lengths == n) for n in np.unique(self.lengths) if n}
        # for each length class: table[block, value] is the bitmap of the items to look at
        self.tables = {}
        for n, items in self.by_length.items():
            table = np.zeros((8, 256, len(items)), bool)
            blocks = self.prints[items].astype("<u8").view(np.uint8).reshape(-1, 8)
            for block in range(8):
                for k, value in enumerate(blocks[:, block]):
                    table[block, value ^ self.near, k] = True
            self.tables[n] = np.packbits(table, axis=2)
        # the items of each known shingle, one after another
        owners = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
        self.owners, self.first = owners[np.argsort(pool, kind="stable")], np.concatenate([[0], np.cumsum(counts)])
        self.place = np.zeros(len(self.sets), int)
        for items in self.by_length.values():
            self.place[items] = np.arange(len(items))
        # shingles that decide which windows are looked at, per length class
        self.of_length = {n: np.unique(np.concatenate([self.sets[i] for i in items])) for n, items in self.by_length.items()}

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(hashes))
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.weight[at], 1.0)

    def matches(self, row: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first shingle, shingles) of the best window of each item that reaches the threshold."""
        if not len(row) or not len(self.known):
            return []
        at = np.minimum(np.searchsorted(self.known, row), len(self.known) - 1)
        hit = self.known[at] == row
        if not hit.any():
            return []
        weights = np.where(hit, self.weight[at], 1.0)
        shared = np.unique(np.concatenate([self.owners[self.first[k] : self.first[k + 1]] for k in np.unique(at[hit])]))
        best: dict[int, tuple[float, int, int]] = {}
        for n in np.unique(self.lengths[shared]).tolist():
            items = self.by_length[n]
            # the bytes of the tables' rows that name an item with a shingle of this document, and those items' bits in them
            wanted = np.zeros(len(items), bool)
            wanted[self.place[shared[self.lengths[shared] == n]]] = True
            bits = np.packbits(wanted)
            columns = np.flatnonzero(bits)
            here = np.flatnonzero(hit & np.isin(row, self.of_length[n]))
            if not len(here):
                continue
            width = min(n, len(row))
            # windows that hold a hit: starts from width - 1 before it up to the hit itself
            marks = np.zeros(len(row) + 1, int)
            np.add.at(marks, np.maximum(here - width + 1, 0), 1)
            np.add.at(marks, here + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks)[: len(row) - width + 1] > 0)
            for part in np.array_split(starts, -(-len(starts) // max(1, min(4096, MOST_CELLS // len(columns))))):
                lo, hi = int(part[0]), int(part[-1]) + width
                sums = np.concatenate([np.zeros((1, 64)), np.cumsum(votes(row[lo:hi]) * weights[lo:hi, None], axis=0, dtype=np.float64)])
                prints = signs(sums[part - lo + width] - sums[part - lo])
                blocks = prints.astype("<u8").view(np.uint8).reshape(-1, 8)
                found = np.zeros((len(part), len(columns)), np.uint8)
                for b in range(8):
                    found |= self.tables[n][b][np.ix_(blocks[:, b], columns)]
                for w, k in zip(*np.nonzero(np.unpackbits(found & bits[columns], axis=1)), strict=True):
                    item, start = int(items[columns[k // 8] * 8 + k % 8]), int(part[w])
                    s = self.similarity(np.unique(row[start : start + width]), item)
                    if s >= threshold and (item not in best or s > best[item][0]):
                        best[item] = (s, start, width)
        return [(i, *b) for i, b in sorted(best.items())]

    def similarity(self, window: np.ndarray, item: int) -> float:
        both = self.weigh(np.intersect1d(window, self.sets[item], assume_unique=True)).sum()
        return float(both / (self.weigh(window).sum() + self.weigh(self.sets[item]).sum() - both))


def load(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Benchmark:
    n, chars = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()
    if n > MOST_ITEMS or chars > MOST_CHARS:
        raise ValueError(f"a benchmark of {n} items and {chars} characters is too large to send to every task")
    rows = sorted((tuple(r) for r in benchmark.select(id_col, text_col).collect()), key=repr)
    return Benchmark([r[0] for r in rows], [r[1] for r in rows])


MATCH = "item_id bigint, similarity double, first_shingle bigint, n_shingles bigint"


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, out: str = "matches") -> DataFrame:
    """The columns ``keep`` of every document row, and in ``out`` an array of structs, empty for clean documents."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast(load(benchmark, item_col, item_text))  # bounded by load()
    names = [x.split()[0] for x in MATCH.split(", ")]
    kind = pa.list_(pa.struct([(n, pa.float64() if n == "similarity" else pa.int64()) for n in names]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        bench = held.value
        for batch in batches:
            rows = []
            for row in shingle_rows(batch.column(len(keep)).to_pylist()):
                best: dict = {}
                for item, *rest in bench.matches(row, threshold):
                    best[bench.ids[item]] = max(best.get(bench.ids[item], (0.0,)), tuple(rest), key=lambda x: x[0])
                rows.append([dict(zip(names, (i, *b), strict=True)) for i, b in best.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, kind)], [*keep, out])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    # a text column that is kept goes along once more under a name of its own
    source = docs.select(*keep, F.col(text_col).alias("text to scan"))
    return source.mapInArrow(scan, f"{schema}, `{out}` array<struct<{', '.join(x.replace(' ', ': ') for x in MATCH.split(', '))}>>")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns."""
    out = common.free_name(docs, "benchmark passages")
    found = find(docs, benchmark, docs.columns, text_col, threshold=threshold, out=out)
    return found.filter(F.size(out) == 0).select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
