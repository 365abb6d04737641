import random
import re

import numpy as np

from tessera.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def brute(docs, items):
    """Best weighted similarity of any item-sized window, over all windows and items."""
    rows = {i: shingles(words(t)) for i, t in items}
    holders = {}
    for s in rows.values():
        for x in set(s):
            holders[x] = holders.get(x, 0) + 1
    total = lambda s: sum(1 / holders.get(x, 1) for x in s)
    out = {}
    for d, t in docs:
        row = shingles(words(t))
        for i, item in rows.items():
            if not item or not set(item) & set(row):
                continue
            n = min(len(item), len(row))
            best = max(total(set(item) & (w := set(row[k : k + n]))) / total(set(item) | w) for k in range(len(row) - n + 1))
            if best >= 0.8:
                out[d, i] = round(best, 6)
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect() for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = brute([tuple(r) for r in docs], [tuple(r) for r in items])
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in D.op6_decontaminate(spark, sf).collect()}
    assert got == want and want


def test_changed_passages_and_edge_rows(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**5)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 60)))) for i in range(40)] + [(40, "one two"), (41, None), (42, ""), (3, "again " * 30), (43, "a b c d e f g")]
    docs = []
    for d in range(200):
        body = [word() for _ in range(rng.randrange(0, 200))]
        w = rng.choice(items[:40])[1].upper().split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = word()
        k = rng.randrange(len(body) + 1)
        docs.append((d, "\n".join([" ".join(body[:k]), "  ".join(w), " ".join(body[k:])])))
    docs += [(1000, None), (1001, ""), (1002, "One\tTWO"), (1003, "x " * 100_000), (1004, "again " * 50_000), (1005, "a b c d e f g"), (1005, "a b c d e f g"), (None, "one two")]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, matches int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [(r.doc_id, m.item_id, m.similarity) for r in D.find(df, bench, ["doc_id"]).collect() for m in r.matches]
    want = brute(docs, items[:43] + [(-3, items[43][1]), items[44]])
    want = {(d, 3 if i == -3 else i): s for (d, i), s in want.items()}
    got = {(d, i): round(s, 6) for d, i, s in found}
    missed = want.keys() - got.keys()
    assert got.items() <= want.items() and len(missed) <= 0.01 * len(want)
    assert not [m for m in missed if want[m] > 0.9]
    assert sum(d == 1005 for d, _, _ in found) == 2
    kept = D.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == len(docs) - len({k for k, (d, _) in enumerate(docs) if any(d == g[0] for g in got)})
    assert D.find(df.limit(0), bench, ["doc_id"]).count() == 0
    assert D.find(df, bench.limit(0), ["doc_id"]).filter("size(matches) > 0").count() == 0


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    bench = D.Benchmark([1], ["a b c d e f g h i j"])
    table, n = bench.tables[6], 0
    for _ in range(2000):
        flips = rng.choice(64, rng.integers(0, 24), replace=False)
        other = bench.prints[0] ^ np.uint64(sum(1 << int(f) for f in flips))
        blocks = np.array([other], "<u8").view(np.uint8)
        n += any(table[b][blocks[b]].any() for b in range(8))
    assert n == 2000
