import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import collocations as C


def brute(rows, max_n, min_count, contained, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        rows = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inner = {}
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner.get(p[i : i + k], 0), a)
        for p, a in candidates.items():
            score, k = min((int(Fraction(1000 * a * n[lang], counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p)))
            if 100 * inner.get(p, -1) < contained * a:
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def made_rows(seed, many):
    rng = random.Random(seed)
    words = ["new", "New", "york", "é", "É", "x\x01", "a b", "1", "日本", "big", "apple", "z" * 400, "\x00"]
    glue = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r\n", "?!", "-"]
    rows = [(rng.choice(["en", "en", "en", None, "und", "de", ""]), "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(60)))) for _ in range(many)]
    return rows + [("en", "to be or not to be " * 30), ("en", "to be or not to be, " * 30)] * 2 + [("xx", None), ("en", ""), (None, " . "), ("de", "one")]


@pytest.mark.parametrize("max_n, min_count, contained, top", [(5, 4, 100, 2000), (5, 3, 60, 7), (3, 5, 100, 50), (2, 4, 100, 50), (4, 1, 90, 5)])
def test_equals_brute_force(spark, max_n, min_count, contained, top):
    rows = made_rows(max_n * 10 + min_count, 150)
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, text string, words int, phrase string").repartition(3)
    got = sorted(tuple(r) for r in C.collocations(df, max_n, min_count, contained, top).collect())
    assert got == brute(rows, max_n, min_count, contained, top) and got
    assert C.collocations(df.limit(0), max_n, min_count).count() == 0


def test_results_do_not_depend_on_the_set_of_bits_or_on_blocks(spark, monkeypatch):
    rows = made_rows(3, 120)
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(C, "bits_of", lambda frequent: bytes([255]) * (C.FILTER_BITS // 8))
    want = sorted(tuple(r) for r in C.collocations(df, 5, 4).collect())
    assert want == brute(rows, 5, 4, 100, 2000)
    for size in (1, 50, 3000):
        monkeypatch.setattr(C, "BLOCK", size)
        blocks = list(C.blocks([t or "" for _, t in rows]))
        assert b"".join(blocks) == b"".join(C.blocks([t or "" for _, t in rows])) and all(b.endswith(b"\xff") for b in blocks)
        tally = Counter()
        for block in blocks:
            for n, found, counts in C.phrases(*C.tokens(block), 2, 3):
                assert all(w.count(b" ") == n - 1 for w in found.to_pylist())
                tally.update(dict(zip(found.to_pylist(), counts.tolist(), strict=True)))
        plain = Counter()
        for _, text in rows:
            for piece in re.split(rb"[.,;:!?\n\x0b\x0c\r]", (text or "").encode().lower()):
                w = piece.split()
                plain.update(b" ".join(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
        assert tally == plain


def test_bits_hold_every_frequent_phrase(spark):
    rows = [("en", 2, f"w{i} v{i % 7}") for i in range(3000)] + [("de", 1, "é"), ("", 3, "a b c")]
    bits = np.frombuffer(C.bits_of(spark.createDataFrame(rows, "lang string, words int, phrase string")), np.uint8)
    import xxhash

    for lang, _, phrase in rows:
        h = [np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in phrase.encode().split(b" ")]
        at = int(C.bit(C.together(h, xxhash.xxh64_intdigest(lang.encode())))[0])
        assert bits[at >> 3] >> (at & 7) & 1
    assert int(np.unpackbits(bits).sum()) <= len(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**15 + 7, 10**16 + 3, 10**15 + 9, 10**15 + 11)], "a long, n long, l long, r long")
    a, n, left, right = big.first()
    assert big.select(C.score(*(C.F.col(c) for c in "anlr")).alias("s")).first().s == 1000 * a * n // (left * right)
