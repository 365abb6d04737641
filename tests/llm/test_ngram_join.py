import random
import re

import pytest

from tessera.llm import ngram_join as J
from tessera.llm.components import connected


def brute(rows):
    """(id -> (sizes, component)) by comparing all pairs of distinct texts that share a shingle."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    by, distinct = {}, {}
    for i, s in sets:
        f = frozenset(s)
        if s and f in distinct:
            parent[max(root(i), root(distinct[f]))] = min(root(i), root(distinct[f]))
        elif s:
            distinct[f] = i
    for f, i in distinct.items():
        for x in f:
            by.setdefault(x, []).append((i, f))
    for members in by.values():
        for k, (i, r) in enumerate(members):
            for j, s in members[:k]:
                if root(i) != root(j) and 100 * len(r & s) >= 80 * len(r | s):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((i, len(s), root(i)) for i, s in sets)


def rows_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(J.op9_ngram_join(spark, f"/root/testdata/{sf}")) == brute([(r.doc_id, r.text) for r in docs])


def test_random_near_copies(spark):
    """Sizes at every band edge, changes around the threshold, one large group, and small sets."""
    rng, rows = random.Random(4), []
    word = lambda: f"w{rng.randrange(10**6)}"
    bases = [[word() for _ in range(n)] for n in [*range(1, 40), 60, 80, 83, 85, 86, 100, 240, 244, 247, 250, 300, 730]]
    for base in bases:
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, len(base) // 20))):
                k = rng.randrange(len(copy))
                rng.choice([lambda: copy.__setitem__(k, word()), lambda: copy.insert(k, word()), lambda: copy.pop(k) if len(copy) > 1 else None])()
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(copy)))
    big = [word() for _ in range(120)]
    for _ in range(150):
        copy = list(big)
        copy[rng.randrange(120)] = word()
        rows.append((len(rows), " ".join(copy).upper()))
    rng.shuffle(rows)
    assert rows_of(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)


def test_pairs_meet_in_the_index():
    """Any two sets that are linked share a key, also where sizes lie in different bands."""
    import numpy as np

    rng = np.random.default_rng(9)
    for _ in range(3000):
        n = int(rng.integers(1, 130))
        s = rng.integers(0, 2**63, n).astype(np.uint64)
        cut = int(rng.integers(0, n // 5 + 1))
        extra = int(rng.integers(0, n // 4 + 1))
        t = np.concatenate([s[cut:], rng.integers(0, 2**63, extra).astype(np.uint64)])
        if 100 * (n - cut) >= 80 * (n + extra):
            assert np.isin(J.index_keys(np.unique(s)), J.index_keys(np.unique(t))).any()


def test_edge_rows(spark):
    rows = [(5, None), (6, ""), (7, " \t\n\x0b "), (8, "one two"), (9, "ONE\x0ctwo"), (9, "one two"), (10, "a b c d e"), (11, "a b c d e"), (None, "a b c d e"), (12, "one two"), (13, "x" * 200_000), (14, "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_shingles int, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()), key=repr)
    want = [(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (9, 1, 8), (10, 1, 10), (11, 1, 10), (None, 1, None), (12, 1, 12), (13, 1, 13), (14, 1, 13)]
    assert got == sorted(want, key=repr)
    assert sorted(r.doc_id or 0 for r in J.keep_one(df).collect()) == [0, 5, 6, 7, 8, 10, 12, 13]
    assert J.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, x) for x in range(1000, 1100)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(3, 3), (None, 4)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}
