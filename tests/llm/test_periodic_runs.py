import hashlib
import random
import zlib

import pytest

from tessera.llm import periodic_runs as R


def brute(words, shortest=2):
    """Stretches of equal words at each distance, without those inside a run of a shorter period."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(2 * q, shortest) and not any(s <= start and start + length <= s + m for s, m, _ in found):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_runs_of_short_sequences():
    for n in range(13):
        for bits in range(1 << n):
            words = [bits >> k & 1 for k in range(n)]
            assert R.runs(words) == brute(words), words


@pytest.mark.parametrize("direct", [1, 3, 12])
def test_runs_equal_brute_force(monkeypatch, direct):
    monkeypatch.setattr(R, "DIRECT", direct)
    rng = random.Random(direct)
    for case in (fibonacci(400), thue_morse(300), ["x"] * 200, list("ab") * 90 + list("aab") * 40, list("abcabc") * 30 + ["d"] + list("abcabc") * 30):
        assert R.runs(case) == brute(case)
    for _ in range(400):
        base = [rng.randrange(rng.choice([2, 3, 20])) for _ in range(rng.randrange(1, 40))]
        words = []
        while len(words) < rng.randrange(20, 300):
            words += base * rng.randrange(1, 5) if rng.random() < 0.6 else [rng.randrange(3) for _ in range(5)]
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = 99
        for shortest in (2, 12):
            assert R.runs(words, shortest) == brute(words, shortest), words


def test_hashes_that_meet_are_found_out(monkeypatch):
    monkeypatch.setattr(R, "PRIME", 7)  # nearly every comparison by hash is wrong
    monkeypatch.setattr(R, "DIRECT", 1)
    rng = random.Random(9)
    for _ in range(200):
        words = [rng.randrange(2) for _ in range(80)] * rng.randrange(1, 3)
        assert R.runs(words) == brute(words)


def test_long_texts_take_little_time():
    n = 60_000
    assert R.runs(["x"] * n) == [(0, n, 1)]
    assert R.runs(list(range(n // 2)) * 2) == [(0, n, n // 2)]
    assert R.runs(["a", "b", "c"] * (n // 3)) == [(0, n, 3)]
    assert len(R.runs(fibonacci(n))) > n // 2


def text_of(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def digest(doc_id, text):
    words = text_of(doc_id, text)
    found = brute(words, 12)
    best = min(((-m, s, q) for s, m, q in found), default=None)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    figures = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc_id, len(found), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def test_query_and_edge_rows(spark, tmp_path):
    rng = random.Random(4)
    some = lambda k: "".join(rng.choice("abc") + rng.choice([" ", "\t", "\n", "  ", "\x0b", "\x0c\r", " \xa0 ", " "]) for _ in range(k))
    rows = [(i, some(rng.randrange(120))) for i in range(300)] + [(None, "a a " * 20), (None, None), (7, ""), (8, " \n"), (31, "word"), (31, "word"), (40, "x\x00 é " * 9), (5, "é " * 30_000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, runs string, id int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = R.op11_periodic_runs(spark, str(tmp_path)).collect()
    small = [r for r in rows if len(r[1] or "") < 50_000]
    assert sorted((tuple(r) for r in got if r.doc_id != 5 or r.length != 30_000), key=repr) == sorted((digest(*r) for r in small), key=repr)
    assert [tuple(r)[1:6] for r in got if r.length == 30_000] == [(1, 0, 30_000, 1, 30_000_000)]
    assert R.find(df.limit(0)).count() == 0 and R.find(df).columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_query_over_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in R.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        if len(text_of(d.doc_id, d.text)) < 600:
            assert got[d.doc_id] == digest(d.doc_id, d.text)
