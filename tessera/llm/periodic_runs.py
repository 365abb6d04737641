"""Periodic runs of words: every stretch that repeats with some period and cannot be made longer.

A run is a stretch of at least two periods that no neighbouring word extends. Each run has a Lyndon root: under one of
two opposite orders of the words, the longest Lyndon word that starts somewhere in the run is one period long. So for
both orders a stack is scanned from right to left that keeps, for each place, where the next smaller suffix starts; the
distance to it is a period to try, and the run around it is extended in both directions as far as words agree. Suffixes are
compared, and runs extended, by their longest common extension: a few words directly, then binary search on rolling
hashes modulo 2**61 - 1, of which the outcome is verified word by word. Extensions at a distance are remembered, so that
a long run is verified once and not from each of its places. No suffix array is built.

Places whose words at the tried period agree on neither side cannot lie in a run and are left out by array
comparisons before anything is extended.

Defined cases: a null or empty text has no words and no runs; texts of any length are scanned whole, in one task each, in
time n log n apart from verification; one word repeated for a whole text is one run of period 1; equal stretches that
overlap by less than a period are two runs; repeated rows and repeated or null ids are kept, one row each; an empty table gives an empty
table; the other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.sharding import CRC, CRC_TABLE

PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
#: Words compared one by one before hashes are used.
DIRECT = 12


class Extensions:
    """How far two places of a sequence agree to the right; ``codes`` ends with a code that no word has."""

    def __init__(self, codes: list[int]):
        self.codes, self.n = codes, len(codes) - 1
        self.array = np.array(codes, np.int64)
        self.near: dict[int, tuple[int, int]] = {}  # distance -> the last left place and its extension
        self.sums: list[int] | None = None

    def prepare(self) -> None:
        self.sums = list(accumulate(self.codes[: self.n], lambda h, c: (h * BASE + c + 1) % PRIME, initial=0))
        self.powers = list(accumulate(range(self.n), lambda p, _: p * BASE % PRIME, initial=1))

    def right(self, i: int, j: int) -> int:
        """For i < j: how many words from i on equal those from j on."""
        codes, k = self.codes, 0
        while k < DIRECT:
            if codes[i + k] != codes[j + k]:
                return k
            k += 1
        d = j - i
        known = self.near.get(d)
        if known and known[0] >= i and self.equal(i, j, known[0] - i):
            found = known[0] - i + known[1]
        else:
            found = self.search(i, j, k)
        self.near[d] = (i, found)
        return found

    def search(self, i: int, j: int, known: int) -> int:
        if self.sums is None:
            self.prepare()
        sums, powers = self.sums, self.powers

        def alike(k: int) -> bool:
            return (sums[i + k] - sums[j + k] - (sums[i] - sums[j]) * powers[k]) % PRIME == 0

        low, high, most = known, known * 2, self.n - j  # alike up to low
        while high < most and alike(high):
            low, high = high, high * 2
        high = min(high, most + 1)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if alike(middle) else (low, middle)
        if self.codes[i + low] != self.codes[j + low] and self.equal(i, j, low):
            return low
        return int(np.argmax(self.array[i : i + most] != self.array[j : j + most])) if not self.equal(i, j, most) else most  # hashes met by chance

    def equal(self, i: int, j: int, k: int) -> bool:
        if k < 64:
            return self.codes[i : i + k] == self.codes[j : j + k]
        return bool((self.array[i : i + k] == self.array[j : j + k]).all())


def next_smaller(codes: list[int], right: Callable[[int, int], int]) -> list[int]:
    """For each place the next one whose suffix is smaller; ``codes`` ends with a code below all others."""
    n = len(codes) - 1
    smaller = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        c, j = codes[i], i + 1
        while True:
            other = codes[j]
            if c > other:
                break
            if c == other:
                k = right(i, j)
                if codes[i + k] > codes[j + k]:
                    break
            j = smaller[j]
        smaller[i] = j
    return smaller


def runs(words: list, shortest: int = 2) -> list[tuple[int, int, int]]:
    """All runs of at least ``shortest`` words as (start, length, period), by start and period."""
    n = len(words)
    if n < 2:
        return []
    number: dict = {}
    up = [number.setdefault(w, len(number)) for w in words]
    ahead = Extensions([*up, -1])
    behind: Extensions | None = None
    found, array = set(), np.array([*up, -1, -2], np.int64)  # beyond the end nothing agrees
    places = np.arange(n)
    for codes in ([*up, -1], [*(-c for c in up), -len(number) - 1]):
        stops = np.array(next_smaller(codes, ahead.right)[:n])
        periods = stops - places
        agree = array[stops] == array[:n]
        agree[1:] |= array[: n - 1] == array[stops[1:] - 1]
        agree &= periods * 2 <= n
        last: dict[int, tuple[int, int]] = {}  # period -> first and last place of its latest run
        for i, p in zip(np.flatnonzero(agree).tolist(), periods[agree].tolist(), strict=True):
            if p in last and last[p][0] <= i and i + p - 1 <= last[p][1]:
                continue
            if behind is None:
                behind = Extensions([*reversed(up), -1])
            after = ahead.right(i, i + p)
            before = behind.right(n - i - p, n - i) if i else 0
            length = p + after + before
            last[p] = (i - before, i + p + after - 1)
            if length >= max(shortest, 2 * p):
                found.add((i - before, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, of each run only the first period."""
    dropped = bytearray(len(words))
    for start, length, period in found:
        dropped[start + period : start + length] = b"\1" * (length - period)
    return b" ".join([w for w, gone in zip(words, dropped, strict=True) if not gone] if found else words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 12) -> DataFrame:
    """Rows (id, n_words, runs array<struct<start, length, period>>, collapsed): the runs by start and period, as word numbers,
    and the words that are left if each run keeps its first period only."""
    common.small_batches(df.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            counts, rows, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().split()  # bytes: at space and the five control characters, at nothing else
                found = runs(words, shortest)
                counts.append(len(words))
                rows.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(collapsed(words, found).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(rows, pa.list_(RUN)), pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(scan, f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


# --- the query: some documents are made periodic from a word on, chosen by their id ---------------------------------

SHORTEST = 12


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for ids with crc32 divisible by 10 its words with a period from some word on; a null id changes nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    with_words = F.struct(words.alias("w"), g.alias("g"))

    def repeat(s: Column) -> Column:
        n = F.size(s["w"]).cast("bigint")
        a = s["g"] % n
        p = 1 + F.floor((n - a) / (3 + s["g"] % 8))
        return F.array_join(F.concat(F.slice(s["w"], 1, a.cast("int")), F.transform(F.sequence(a, n - 1), lambda i: F.get(s["w"], (a + (i - a) % p).cast("int")))), " ")

    made = F.get(F.transform(F.filter(F.array(with_words), lambda s: F.size(s["w"]) > 0), repeat), 0)
    return F.when(h % 10 == 0, made).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = find(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), shortest=SHORTEST)
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(order)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["s"].alias("start"),
        (-best["l"]).alias("length"),
        best["p"].alias("period"),
        F.floor(-best["l"] * 1000 / best["p"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The same by comparing every two equal words of a document: stretches at each distance, without those inside a run of a shorter period.
ORACLE = rf"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes, {CRC_TABLE} AS crc_table FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, ({CRC})::BIGINT AS h FROM h),
p AS (SELECT doc_id, w, n, h, CASE WHEN n > 0 THEN (h // 10) % n END AS a, CASE WHEN n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
o AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) t GROUP BY doc_id, q, k HAVING count(*) + q >= greatest({SHORTEST}, 2 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.doc_id = s.doc_id AND z.q < s.q AND z.s <= s.s AND z.s + z.l >= s.s + s.l)),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
m AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
c AS (SELECT o.doc_id, string_agg(o.word, ' ' ORDER BY o.i) AS kept FROM o LEFT JOIN gone ON gone.doc_id = o.doc_id AND gone.i = o.i WHERE gone.i IS NULL GROUP BY o.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, m.s::BIGINT AS start, m.l::BIGINT AS length, m.q::BIGINT AS period, (1000 * m.l // m.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
