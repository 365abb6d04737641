"""Phrase collocations of each language: word sequences that occur together far more often than their parts suggest.

Texts are split into pieces at punctuation and pieces into words; a phrase never spans two pieces. All phrases of 1 to
``max_n`` words become rows (language, phrase, count) and are counted by hash aggregation. A candidate has at least two words and
``min_count`` occurrences. For each cut of a candidate into two parts the counts l and r of the parts are joined, and its
score is floor(1000 * a * n / (l * r)) in decimals, with n the words of the language; the weakest cut counts. A candidate goes if
a phrase one word longer occurs ``contained`` percent as often (longer phrases still occur no more often than those one word longer, so
these suffice). What is left is ranked within its language.

Rows are exploded in three passes (one word, two words, the rest). A phrase can only reach ``min_count`` if all parts of it
do, so the second and third pass leave out occurrences with a part that the pass before has counted below it. That test
is a set of bits of fixed size (``FILTER_BITS``, whatever the input), which every task gets: it may let a rare phrase through,
which is then counted exactly like any other, and never holds a frequent one back. Results do not depend on it.

Defined cases: a null language is ``und`` (and joins what is called so); a null or empty text has no words; texts
of any length are read piece by piece; repeated rows count each time; other columns are not read, whatever their names; an empty table
gives no rows; ties in score and count go by the bytes of the phrase, so ranks never tie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Ends of pieces, and the languages' name where there is none.
BREAKS, NO_LANG = b".,;:!?\n\x0b\x0c\r", "und"
#: Bits of the set of frequent parts (16 MB in every task, for any input), and the bytes of one of Spark's bitmaps.
FILTER_BITS, CHUNK = 1 << 27, 4096
#: Bytes of text that are tokenised at once; longer texts are cut between pieces.
BLOCK = 4 << 20
#: A byte that UTF-8 never has stands for a break.
_BREAK = b"\xff"
_PLAIN = bytes.maketrans(BREAKS + bytes(range(65, 91)), _BREAK * len(BREAKS) + bytes(range(97, 123)))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def blocks(texts: Iterable[str]) -> Iterator[bytes]:
    """The texts in lower case, with breaks as one byte and a break after each text, in blocks that end between pieces."""
    held, size = [], 0
    for text in texts:
        raw, at = text.encode().translate(_PLAIN) + _BREAK, 0
        while len(raw) - at > BLOCK:
            end = raw.index(_BREAK, at + BLOCK) + 1
            yield raw[at:end]
            at = end
        held.append(raw[at:])
        size += len(raw) - at
        if size > BLOCK:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def tokens(block: bytes) -> tuple[pa.Array, np.ndarray]:
    """The different words of a block, and for each place in it the word's number there or -1 for a break."""
    coded = pa.array(block.replace(_BREAK, b" \xff ").split(), pa.binary()).dictionary_encode()
    words, places = coded.dictionary, coded.indices.to_numpy()
    return words, np.where(places == words.index(_BREAK).as_py(), -1, places)


def hashed(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], np.uint64)


def bit(hashes: np.ndarray) -> np.ndarray:
    """The place in the set of bits."""
    return ((hashes ^ (hashes >> np.uint64(29))) * _MIX >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))).astype(np.int64)


def together(parts: list[np.ndarray], lang: int) -> np.ndarray:
    """The hash of a phrase from those of its words and of its language."""
    h = np.full(len(parts[0]), lang, np.uint64)
    for part in parts:
        h = h * _STEP + part
    return h


def phrases(words: pa.Array, places: np.ndarray, shortest: int, longest: int, lang: int = 0, bits: np.ndarray | None = None) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """For every length the phrases of a block whose parts of ``shortest`` - 1 words may all be frequent, and their counts."""
    part = max(shortest - 1, 1)
    starts = np.flatnonzero(places >= 0)
    for k in range(1, part):
        starts = starts[places[starts + k] >= 0]  # the last place is a break, so none of these lies beyond
    if bits is not None:
        of_word = hashed(words)
        at = bit(together([of_word[places[starts + k]] for k in range(part)], lang))
        starts = starts[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
    good = np.zeros(len(places) + longest, bool)
    good[starts] = True
    number = np.zeros(len(places), np.int64)  # of the phrase of n words that starts at a place, among those of n words
    for n in range(1, longest + 1):
        if n > part:  # the part that ends with the next word must be good as well
            starts = starts[good[starts + n - part]]
        longer = number[starts] * len(words) + places[starts + n - 1]
        _, first, number[starts], counts = np.unique(longer, return_index=True, return_inverse=True, return_counts=True)
        if n >= shortest and len(first):
            each = [words.take(pa.array(places[starts[first] + k])) for k in range(n)]
            yield n, pc.binary_join_element_wise(*each, b" ") if n > 1 else each[0], counts


def explode(docs: DataFrame, shortest: int, longest: int, bits: bytes | None) -> DataFrame:
    """Rows (lang, phrase, n): occurrences of phrases, counted as far as a block goes."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(bits) if bits is not None else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        kept = np.frombuffer(shared.value, np.uint8) if shared else None
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                of = xxhash.xxh64_intdigest(lang.encode())
                for block in blocks(texts):
                    for _, found, counts in phrases(*tokens(block), shortest, longest, of, kept):
                        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(counts), np.int8))), found.cast(pa.string()), pa.array(counts)], ["lang", "phrase", "n"])

    return docs.mapInArrow(scan, "lang string, phrase string, n bigint")


def bits_of(frequent: DataFrame) -> bytes:
    """The set of bits of the phrases (lang, phrase); FILTER_BITS / 8 bytes reach the driver, as Spark's bitmaps of 4 KB."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(xxhash.xxh64_intdigest(lang.encode()), [xxhash.xxh64_intdigest(w) for w in phrase.encode().split(b" ")]) for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            of = [together([np.array([h], np.uint64) for h in words], lang)[0] for lang, words in rows]
            yield pa.RecordBatch.from_arrays([pa.array(bit(np.array(of, np.uint64)) + 1)], ["bit"])  # bitmaps count from 1

    chunks = frequent.select("lang", "phrase").mapInArrow(places, "bit bigint").groupBy(F.bitmap_bucket_number("bit").alias("chunk"))
    held = bytearray(FILTER_BITS // 8)
    for r in chunks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        held[(r.chunk - 1) * CHUNK : r.chunk * CHUNK] = r.bits
    return bytes(held)


def counted(docs: DataFrame, max_n: int, min_count: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tables (lang, phrase, f) of all phrases with at least ``min_count`` occurrences, and (lang, n) of all words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text")).filter("length(text) > 0")
    total = lambda rows: rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    words = common.materialise(total(explode(texts, 1, 1, None)), "phrases-1")
    per_lang = words.groupBy("lang").agg(F.sum("f").alias("n"))
    level, found, done = words.filter(F.col("f") >= min_count), [], 1
    found.append(level)
    for longest in (2, max_n):
        if longest <= done:
            continue
        level = common.materialise(total(explode(texts, done + 1, longest, bits_of(level))).filter(F.col("f") >= min_count), f"phrases-{longest}")
        found.append(level)
        done = longest
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    return every, per_lang


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)): at most 1000 * n, all products exact within 38 digits."""
    whole = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (whole(a) * whole(n)).cast("decimal(34,0)"), whole(l) * whole(r))


def collocations(docs: DataFrame, max_n: int = 5, min_count: int = 100, contained: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    every, per_lang = counted(docs, max_n, min_count, lang_col, text_col)
    word = F.split("phrase", " ")
    candidates = every.withColumn("words", F.size(word)).filter("words > 1").withColumnRenamed("f", "a")
    cut = candidates.select("lang", "phrase", "words", "a", word.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    cut = cut.join(every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cut = cut.join(per_lang, "lang").withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    weakest = F.min_by(F.struct("l", "r", "n", "score"), F.struct("score", "k"))
    scored = cut.groupBy("lang", "phrase", "a").agg(weakest.alias("s")).select("lang", "phrase", "a", "s.*")
    longer = candidates.filter("words > 2").select("lang", "a", word.alias("w"), "words")
    inner = longer.select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", 1, F.col("words") - 1), " "), F.array_join(F.slice("w", 2, F.col("words") - 1), " "))).alias("phrase"))
    extended = inner.groupBy("lang", "phrase").agg(F.max("a").alias("of"))
    s, e = scored.alias("s"), extended.alias("e")
    kept = s.join(e, (F.col("s.lang") == F.col("e.lang")) & (F.col("s.phrase") == F.col("e.phrase")) & (F.lit(100) * F.col("e.of") >= F.lit(contained) * F.col("s.a")), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


MAX_N, MIN_COUNT, CONTAINED, TOP = 5, 100, 100, 2000


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"), MAX_N, MIN_COUNT, CONTAINED, TOP)


ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
o AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, {MAX_N} + 1)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM o GROUP BY ALL),
t AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS words, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= {MIN_COUNT}),
u AS (SELECT lang, phrase, words, w, a, unnest(range(1, words)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.words, u.a, u.cut, x.f AS l, y.f AS r, t.n, (1000 * u.a::HUGEINT * t.n) // (x.f::HUGEINT * y.f::HUGEINT) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1 : u.cut], ' ')
             JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.cut + 1 : u.words], ' ') JOIN t ON t.lang = u.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT c.lang, array_to_string(c.w[i : i + k - 1], ' ') AS phrase, max(c.a) AS of
      FROM (SELECT lang, w, a, words, k, unnest(range(1, words - k + 2)) AS i FROM c, (SELECT unnest(range(2, {MAX_N})) AS k) WHERE words > k) c GROUP BY ALL)
SELECT m.lang, rank, m.phrase, m.a::BIGINT AS a, m.l::BIGINT AS l, m.r::BIGINT AS r, m.n::BIGINT AS n, m.score::BIGINT AS score
FROM (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY m.score DESC, m.a DESC, m.phrase) AS rank
      FROM m WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = m.lang AND x.phrase = m.phrase AND 100 * x.of >= {CONTAINED} * m.a)) m
WHERE rank <= {TOP}
"""
