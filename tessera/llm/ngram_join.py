"""Exact self-join of word-shingle sets by Jaccard similarity, and the groups that its links form.

A document is the set of its distinct shingles of five words. Two sets r, s are linked when 100 * |r & s| >= 80 * |r | s|;
then their sizes differ by a factor of 1.25 at most, and they differ in at most |x| // 4 elements, x being either.

Candidates come from a partition of the universe of shingles. Sizes fall into bands; each band has m segments, and a
shingle's hash says which one it belongs to. At most |x| // 4 segments of a pair can differ, so some of the others are equal
on both sides. Allocation says what a set puts into the index for each of its segments:

* -1, nothing: for empty segments, and for as many as the bound allows. A pair has at least |X| - |x| // 4 of its |X| segments
  in common, so under one order of all segment subsets the first |x| // 4 + 1 of each side meet (the prefix principle). The
  order is by cost: subsets of more shingles, which are rarer, come first, and before all those with more shingles that a
  sample of about ``SAMPLE_DOCS`` documents does not show to be shared. Samples order the index and decide nothing;
* 0, the subset as it is: for those first |x| // 4 + 1;
* 1, the subset and all its one-deletion neighbours: where a set has fewer filled segments than that. It then indexes every
  subset, with neighbours for those of two and more. A segment with neighbours tolerates one difference, so the filled
  segments plus those of two and more have to reach |x| // 4 + 1; else the set goes on to a scheme of twice the segments
  as well, until one suffices. Two sets meet in the first scheme that suffices for either.

Sets within 1.25 of the next band are indexed there too. Every candidate is verified on the sets themselves.

A bucket of more than ``HOT`` sets mostly says that they hold the same passage. Allocation skips it, and the sets in it are indexed
again in the finest partition, one segment for each shingle: there only the elements that x itself has and the other lacks break
x's segments, so the first fifth of each set meet, in the order of how many of about ``SAMPLE_HOT`` such sets hold the shingle. Linked sets r, s share at least 80 * (|r| + |s|) / 180
shingles, and none before the first that they meet in, so only pairs count in which both have as many from there on. Two sets that
are both in large buckets meet there; any other pair has met in a bucket that is not large.

Buckets of the index are never expanded into all pairs. Each member is first compared with one of them (the hub);
components of the links found settle most buckets. Only members that stay apart from their hub are then compared with the
other members in other components; rarest shingles first, few of those are left that are not nearly alike. As only components are asked for, nothing is lost: a pair left out lies in one component.

Copies are merged within a task before the index is built, and the few that are left, one a task at most, before it is used.

Defined cases: null and empty texts, and texts of white space, have the empty set and are linked with nothing; texts of one to
four words are one shingle; rows of one id stand for one node that has the links of all of them; a null id keeps its
size and has a null component; an empty table gives an empty table; other columns are left out; texts may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import connected
from tessera.llm.word_features import mix, powers

WORDS = 5
NUM, DEN = 80, 100
BAND = 3
#: Segments per shingle of a band's largest sets.
SPREAD = 0.35
#: Sets in buckets of more members are indexed by single shingles as well, and those buckets are not used.
HOT = 8
#: In how many ways the hub of a bucket is chosen.
HUBS = 4
#: The sample from which the index's order is fit, in how many of its distinct sets a shared shingle occurs, and most of these.
SAMPLE_DOCS, SHARED_BY, MOST_SHARED = 8_000, 3, 200_000
#: The same for the finest partition, whose sample is drawn from the sets in large buckets alone.
SAMPLE_HOT, HOT_SHARED_BY, MOST_HOT_SHARED = 10_000, 2, 1_000_000


def shingle_rows(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """The 64-bit hashes of the shingles of each text, in order and with repeats."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, int)
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    upper = (data >= 65) & (data <= 90)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(raw)
    at = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    place = powers(int(at.max()) + 1)
    values = np.where(blank, 0, data + upper * np.uint8(32) + np.uint64(1)).astype(np.uint64) * place[at]
    words = mix(np.add.reduceat(values, starts))
    first = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))
    last = np.searchsorted(starts, ends)
    factor = np.uint64(0x9FB21C651E98DF25)  # odd

    def joined(k: int) -> np.ndarray:
        if len(words) < k:
            return np.zeros(0, np.uint64)
        h = np.full(len(words) - k + 1, np.uint64(k))
        for j in range(k):
            h = h * factor + words[j : len(words) - k + 1 + j]
        return mix(h)

    shingles = joined(n)
    short = {k: joined(k) for k in {int(b - a) for a, b in zip(first, last, strict=True)} if 0 < k < n}
    spans = zip(first.tolist(), last.tolist(), strict=True)
    return [shingles[a : b - n + 1] if b - a >= n else short[b - a][a : a + 1] if b > a else np.zeros(0, np.uint64) for a, b in spans]


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    return [np.unique(row) for row in shingle_rows(texts, n)]


def band_of(size: int) -> int:
    band = 0
    while BAND ** (band + 1) <= size:
        band += 1
    return band


def segments(band: int, scheme: int) -> int:
    return max(8, int(SPREAD * BAND ** (band + 1)) + 1) << scheme


def keys_in(items: np.ndarray, rare: np.ndarray, band: int, scheme: int) -> tuple[np.ndarray, bool]:
    """What a set indexes in one band and scheme, and whether that suffices for its own pairs."""
    seed = mix(np.array([band * 64 + scheme], np.uint64))[0]
    spread = mix(items ^ seed)
    segment = spread % np.uint64(segments(band, scheme))
    order = np.argsort(segment, kind="stable")
    segment, spread = segment[order], spread[order]
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sizes = np.diff(starts, append=len(items))
    label = mix(segment[starts] + seed)
    sums = np.add.reduceat(spread, starts)
    exact = mix(sums ^ label)
    need = len(items) // 4 + 1
    if len(exact) >= need:
        unshared = np.add.reduceat(rare[order].astype(np.int64), starts)
        return exact[np.lexsort((exact, -sizes, -unshared))[:need]], True
    several = np.repeat(sizes >= 2, sizes)
    fewer = mix((np.repeat(sums, sizes) - spread)[several] ^ np.repeat(label, sizes)[several])
    return np.unique(np.concatenate([exact, fewer])), len(exact) + int((sizes >= 2).sum()) >= need


def index_keys(items: np.ndarray, common_items: np.ndarray = np.zeros(0, np.uint64)) -> np.ndarray:  # noqa: B008
    """``common_items``: sorted shingles that many documents share."""
    if not len(items):
        return np.zeros(0, np.uint64)
    rare = np.ones(len(items), bool)
    if len(common_items):
        rare = common_items[np.minimum(np.searchsorted(common_items, items), len(common_items) - 1)] != items
    band, found = band_of(len(items)), []
    bands = [band, band + 1] if 5 * len(items) >= 4 * BAND ** (band + 1) else [band]
    for b in bands:
        scheme, enough = 0, False
        while not enough:
            keys, enough = keys_in(items, rare, b, scheme)
            found.append(keys)
            scheme += 1
    return np.concatenate(found)


def shared_shingles(texts: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that at least ``least`` distinct texts (text) hold, the most frequent ones if there are too many, and how many hold each."""
    named = texts.select("text").distinct().withColumn("id", F.lit(0).cast("bigint"))
    counts = named.mapInArrow(_items, "id bigint, n bigint, items array<bigint>").select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").cast("int").alias("n"))
    found = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "item").limit(most).toArrow()
    items, n = found["item"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(items)
    return items[order], n[order]


def fine_keys(items: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles that a set indexes in the finest partition, in the order that all sets follow: rare ones first."""
    n, held = len(items), np.zeros(len(items), int)
    if len(known):
        at = np.minimum(np.searchsorted(known, items), len(known) - 1)
        held = np.where(known[at] == items, counts[at], 0)
    return items[np.lexsort((items, held))[: n - -(-4 * n // 5) + 1]]


def finely_indexed(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, shared: Broadcast) -> DataFrame:
    """Rows (key, node, left, size) of the documents whose ids are in ``ids``: left counts the set's shingles from the key on."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            keys, columns = [np.zeros(0, np.uint64)], [np.zeros((3, 0), np.int64)]
            for node, items in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist()), strict=True):
                if n := len(items):
                    keys.append(fine_keys(items, *shared.value))
                    k = len(keys[-1])
                    columns.append(np.stack([np.full(k, node), n - np.arange(k), np.full(k, n)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *map(pa.array, np.concatenate(columns, axis=1))], ["key", "node", "left", "size"])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return common.semi_by_id(source, ids, "id").mapInArrow(build, "key bigint, node bigint, left bigint, size bigint")


def indexed(docs: DataFrame, id_col: str, text_col: str, shared: Broadcast) -> DataFrame:
    """Rows (id, n_shingles, digest, first_id, keys): keys are empty where a document repeats the set of ``first_id`` in its task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        seen: dict[bytes, int] = {}
        for batch in batches:
            ids, sets = batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist())
            digests = [hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) and i is not None else None for i, items in zip(ids, sets, strict=True)]
            firsts, keys = [], []
            for i, items, digest in zip(ids, sets, digests, strict=True):
                firsts.append(seen.setdefault(digest, i) if digest else i)
                keys.append(index_keys(items, shared.value).view(np.int64) if firsts[-1] == i and i is not None else np.zeros(0, np.int64))
            lengths = np.array([len(k) for k in keys])
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(firsts, pa.int64()), flat], ["id", "n_shingles", "digest", "first_id", "keys"])

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(build, "id bigint, n_shingles bigint, digest binary, first_id bigint, keys array<bigint>")


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) or (text, id) batches as (id, n, items)."""
    common.release()
    for batch in batches:
        sets = [s.view(np.int64) for s in shingle_sets(batch.column("text").to_pylist())]
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), flat], ["id", "n", "items"])


def with_sets(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """Rows (id, n, items) of the documents whose ids are in ``ids``."""
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return common.semi_by_id(source, ids, "id").mapInArrow(_items, "id bigint, n bigint, items array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    side = lambda c, *more: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), *(F.col(m).alias(f"{m}_{c}") for m in more))
    # sizes first, which are small; then the sets of the pairs that are left
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b) and least(n_a, n_b) > 0")
    near = common.materialise(near.select("a", "b").distinct(), "ngram-near")
    held = lambda c: common.semi_by_id(sets, near.select(F.col(c).alias("id")), "id").select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("items").alias(f"items_{c}"))
    both = near.join(held("a"), "a").join(held("b"), "b")
    common_items = F.size(F.array_intersect("items_a", "items_b"))
    return both.filter(DEN * common_items >= NUM * (F.col("n_a") + F.col("n_b") - common_items)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id), one for each row of ``docs``."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(shared_shingles(common.bounded_sample(texts, "id", SAMPLE_DOCS), SHARED_BY, MOST_SHARED)[0])  # MOST_SHARED numbers at most
    index = common.materialise(indexed(docs, id_col, text_col, shared), "ngram-index")
    # copies in different tasks: one of them stands for all
    heads = index.filter("first_id = id and digest is not null").select("id", "digest")
    chief = heads.groupBy("digest").agg(F.min("id").alias("chief"), F.max("id").alias("last")).filter("chief < last").select("digest", "chief")
    doubles = common.materialise(heads.join(chief, "digest").filter("id <> chief").select("chief", "id", "digest").distinct(), "ngram-doubles")
    # a row that is a copy leaves the index, other rows of its id stay
    copied = doubles.select("id", "digest").distinct()
    once = common.semi_by_id(index.select("id", "digest", "keys"), copied, ["id", "digest"], "left_anti")
    entries = once.select(F.explode("keys").alias("key"), F.col("id").alias("node")).repartition("key")  # one shuffle serves both uses
    # which member is the hub changes with the bucket, so that a set of a large group meets several
    turn = F.struct(F.xxhash64("node", F.pmod("key", F.lit(HUBS))), "node")
    hubs = entries.groupBy("key").agg(F.min(turn).alias("hub"), F.min("node").alias("low"), F.max("node").alias("top"), F.count("*").alias("n")).filter("low < top").select("key", "hub.node", "n").withColumnRenamed("node", "hub")
    found = common.materialise(entries.join(hubs.hint("shuffle_hash"), "key"), "ngram-buckets")
    # sets in large buckets are indexed once more, by single shingles; pairs of them need not meet in large buckets
    hot = common.materialise(found.filter(F.col("n") > HOT).select(F.col("node").alias("id")).distinct(), "ngram-hot")
    sample = common.semi_by_id(texts, common.bounded_sample(hot, "id", SAMPLE_HOT), "id")
    order = spark.sparkContext.broadcast(shared_shingles(sample, HOT_SHARED_BY, MOST_HOT_SHARED))  # MOST_HOT_SHARED pairs of numbers at most
    fine = common.materialise(finely_indexed(docs, id_col, text_col, hot, order), "ngram-fine")
    leads = fine.groupBy("key").agg(F.min(F.when(F.expr("9 * left >= 8 * size"), turn)).alias("hub"), F.min("node").alias("low"), F.max("node").alias("top")).filter("hub is not null and low < top").select("key", F.col("hub.node").alias("hub"))
    few = found.filter(F.col("n") <= HOT).select("key", "node", "hub")
    buckets = common.materialise(few.unionByName(fine.join(leads, "key"), allowMissingColumns=True), "ngram-buckets")
    common.forget(found, fine, hot)

    pair = [F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")]
    counted = common.materialise(buckets.filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("times")), "ngram-counted")
    pairs = common.materialise(counted.select(*pair).distinct(), "ngram-pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = common.materialise(with_sets(docs, id_col, text_col, met), "ngram-sets")
    copies = index.filter("first_id <> id").select(F.col("first_id").alias("a"), F.col("id").alias("b"))
    # each member's pair with the hub it meets most often is verified first; the components of those links spare most other pairs
    first = counted.groupBy("node").agg(F.max(F.struct("times", "hub")).alias("best")).select("node", F.col("best.hub").alias("hub")).select(*pair).distinct()
    links = common.materialise(similar(first, sets).union(copies).union(doubles.select("chief", "id")), "ngram-links")
    groups = common.materialise(connected(links, "a", "b"), "ngram-groups")
    label = lambda df, c: df.join(groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    between = lambda df: label(label(df, "a"), "b").filter("of_a <> of_b").select("a", "b")
    second = common.materialise(similar(between(pairs.join(first, ["a", "b"], "left_anti")), sets), "ngram-links")
    links = links.union(second)
    groups = common.materialise(connected(links, "a", "b"), "ngram-groups")

    # members that stay apart from a hub meet those members of the same buckets that are in other components
    apart = between(pairs)
    apart = apart.select(F.col("a").alias("hub"), F.col("b").alias("node")).union(apart.select("b", "a"))
    members = buckets.filter("node <> hub")
    side = lambda df, c: label(df.select("key", F.col("node").alias(c), F.col("left").alias(f"left_{c}"), F.col("size").alias(f"size_{c}")), c)
    alone = common.materialise(side(members.join(apart, ["hub", "node"], "left_semi"), "a"), "ngram-alone")
    around = side(members.join(alone.select("key").distinct(), "key", "left_semi"), "b")
    reaches = F.expr(f"of_a <> of_b and (left_a is null or {NUM + DEN} * least(left_a, left_b) >= {NUM} * (size_a + size_b))")
    rest = alone.join(around, "key").filter(reaches).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = common.materialise(rest.join(pairs, ["a", "b"], "left_anti"), "ngram-rest")
    more = common.materialise(similar(rest, sets), "ngram-links")
    if more.limit(1).count():
        groups = common.materialise(connected(links.union(more), "a", "b"), "ngram-groups")
    common.forget(buckets, counted, pairs, sets, doubles, second, alone, rest, more)
    found = index.select("id", "n_shingles").join(groups.withColumnRenamed("node", "id"), "id", "left")
    return found.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; of repeated ids all rows stay, null ids too."""
    groups = near_duplicates(docs, id_col, text_col)
    others = groups.filter(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return common.semi_by_id(docs, others, id_col, "left_anti").select(*docs.columns)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
