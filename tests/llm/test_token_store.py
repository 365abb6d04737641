import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_store as T
from tessera.llm.word_cache import CachedEncoder

TEXTS = ["", " ", "  a  b", "a <|endoftext|> b", "x\n y\t\tz ", "é  b c d", "don't  stop 12 3", " lead", "trail ", "a ÀÉ. x... ,a b1, \x1c c d  e", "ªº ʰ²³ x² ½", "w " * 50_000, "z" * 30_000, "日本 語 한국 😀 é \r\n   x"]


@pytest.mark.parametrize("width", [4, 8, 16])
def test_levels_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 2, 511, 512, 513, 5000):
        for top in (1, 15, 16, 255, 256, 65536, 2**32 - 1):
            ids = rng.integers(0, top, n, endpoint=True).astype(np.uint32)
            levels = T.Levels(b"skip" + T.pack_levels(ids, width), 4)
            assert levels.all().tolist() == ids.tolist()
            assert all(levels[i] == ids[i] for i in rng.integers(0, n, min(n, 60)).tolist())


def test_cached_words_equal_whole_texts():
    path = T.tokenizer_path()
    encoder, plain = CachedEncoder(path, limit=50), Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["a", "B", " ", "  ", "\n", ",", ".", "'s", "1", "é", "ß ", "-", "x y", "\t", "!! "]) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_words_at_line_ends_are_looked_up():
    """Words around line ends are encoded once, as others are, and joined pieces that seldom return are not kept."""
    encoder, plain = CachedEncoder(T.tokenizer_path()), Tokenizer.from_file(T.tokenizer_path())
    asked, word = [], encoder.word
    encoder.word = lambda w: asked.append(w) or word(w)
    text = " ".join(f"{a}.\n{b}" for a in ("one", "Straße", "three") for b in ("Four", "fünf", "six"))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) and not any("\n" in piece for piece in encoder)


def test_words_in_use_stay_when_the_cache_is_full():
    """A word that every text has is encoded once, however many others pass by; what is held stays bounded."""
    encoder, plain = CachedEncoder(T.tokenizer_path(), limit=40), Tokenizer.from_file(T.tokenizer_path())
    asked, word = [], encoder.word
    encoder.word = lambda w: asked.append(w) or word(w)
    for i in range(200):
        text = f"x Straße w{i} q{i} fünf.\nÖl und z{i}"
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(encoder) + len(encoder.old) <= 60 and len(encoder.parts) <= 20
    assert asked.count(" Straße") == asked.count(" fünf") == 1
    small = CachedEncoder(T.tokenizer_path(), most_bytes=4000)
    for i in range(300):
        small.encode(f"some {i} words {'ab' * (i % 20)}")
        assert small.held < 4000


def test_a_large_vocabulary_stays_in_the_cache():
    """350,000 words that all return are encoded once each."""
    encoder = CachedEncoder(T.tokenizer_path())
    model, asked = encoder.model, []

    class Counting:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    encoder.model = Counting()
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:20]][:350_000]
    for _ in range(2):
        for i in range(0, len(words), 500):
            encoder.encode("x " + " ".join(words[i : i + 500]))
    assert len(asked) <= len(words) + 1


def test_pieces_at_white_space_are_not_reused_wrongly():
    """What was kept of one text is right in all others, whatever white space stands around it."""
    encoder, plain = CachedEncoder(T.tokenizer_path()), Tokenizer.from_file(T.tokenizer_path())
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "bc.", "d", " ", " ", " ", "\n", "\t", ",", "\u00a0", "\x1c", "'s", "7"]) for _ in range(rng.randrange(14)))
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_store_equals_the_tokenizer(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([*TEXTS, None, f"doc {i} has words"])) for i in range(300)] + [(None, "null id"), (5, "again"), (5, "again")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 9, b"x") for r in rows], "doc_id long, text string, start int, body binary").repartition(3)
    store = T.write_store(df, T.common.scratch(spark, "test"), T.tokenizer_path(), segment_tokens=2000)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read_documents(store).collect()), key=lambda r: r[0])
    plain, start, want = Tokenizer.from_file(T.tokenizer_path()), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    segment = T.Segment(store.orderBy("part", "seg").first().body)
    assert segment.tokens[0] == segment.tokens.all()[0]
    assert T.read_documents(T.write_store(df.limit(0), T.common.scratch(spark, "test"), T.tokenizer_path())).count() == 0
