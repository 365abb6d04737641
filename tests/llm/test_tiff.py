import os
import random
import struct

import pytest

from tessera.llm import tiff

CODECS = [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]


def samples():
    rng = random.Random(1)
    for n in (0, 1, 5, 63, 64, 65, 300, 1000, 4095, 20_000):
        yield os.urandom(n)
        yield bytes(rng.choice(b"ab ") for _ in range(n))
        yield b"a" * n


@pytest.mark.parametrize("codec", CODECS)
def test_codecs_round_trip(codec):
    for data in samples():
        assert tiff.expand(tiff.compress(data, codec), codec) == data


@pytest.mark.parametrize("codec", CODECS)
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 48])
def test_pages_round_trip(codec, predictor, tile):
    pixels = os.urandom(50 * 70)
    data = tiff.write_page(pixels, 50, codec, predictor, tile, rows_per_strip=7)
    (fields,) = tiff.directories(data)
    facts, read = tiff.read_page(data, fields)
    assert read == pixels and (facts["width"], facts["height"]) == (50, 70)


def test_store_bytes_pads_to_a_positive_multiple():
    for data in samples():
        stored = tiff.store_bytes(data)
        (fields,) = tiff.directories(stored)
        read = tiff.read_page(stored, fields)[1]
        assert read[: len(data)] == data and len(read) % 64 == 0 and read and not any(read[len(data) :])


def test_pages_of_one_file_and_bad_files(spark):
    a, b = b"x" * 640, os.urandom(6400)
    whole = tiff.join_pages([tiff.store_bytes(a), tiff.store_bytes(b), tiff.write_page(b, 64, tiff.LZW, 2, tile=32)])
    loop = bytearray(tiff.store_bytes(a))
    loop[-4:] = loop[4:8]  # the directory names itself as the next
    rows = [(1, bytearray(whole), "p"), (1, bytearray(whole), "p"), (2, None, "p"), (3, bytearray(b"no image"), "p"), (4, loop, None), (None, bytearray(whole[:-30]), "p")]
    df = spark.createDataFrame(rows, "id long, data binary, page string")
    out = tiff.pages(df, "data", ["id"]).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r)
    assert sorted(r.page for r in by[1]) == [0, 0, 1, 1, 2, 2]
    assert {bytes(r.pixels) for r in by[1]} == {a, b}
    assert 2 not in by and by[3][0].error and by[3][0].page is None
    assert [bytes(r.pixels) for r in by[4]] == [a]
    assert any(r.error for r in by[None])
    assert tiff.pages(df.limit(0), "data", ["id"]).count() == 0


def test_query_reads_back_every_text(spark, sf_dir):
    import hashlib
    import zlib

    got = {r.doc_id: r for r in tiff.op7_tiff(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        media = tiff.store_bytes(raw)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        changes = sum(x != y for k in range(0, len(full), 64) for x, y in zip(full[k : k + 63], full[k + 1 : k + 64], strict=True))
        assert r.feature.startswith(f"64x{len(full) // 64}:") and r.feature.endswith(f":{min(full)}-{max(full)}:{sum(full)}:{changes}")
    assert {r.feature.split(":")[1] for r in got.values()} == {"none", "lzw", "packbits", "deflate"}


def changed(data, tag, value):
    """The file with another value of a field of its first directory."""
    out = bytearray(data)
    (at,) = struct.unpack_from("<I", out, 4)
    (count,) = struct.unpack_from("<H", out, at)
    for k in range(count):
        if struct.unpack_from("<H", out, at + 2 + 12 * k)[0] == tag:
            struct.pack_into("<I", out, at + 10 + 12 * k, value)
    return out


def test_broken_sizes_are_rows_with_a_reason(spark):
    page = tiff.write_page(b"abcd" * 160, 64, tiff.DEFLATE)
    several = tiff.write_page(b"abcd" * 160, 64, tiff.DEFLATE, rows_per_strip=2)
    huge = changed(changed(page, 256, 2**31 - 1), 257, 2**31 - 1)
    bad = [changed(page, 256, 0), changed(page, 257, 0), huge, changed(page, 277, 0), changed(page, 278, 0), changed(page, 273, 10**6), changed(page, 279, 3), changed(page, 259, 7), changed(several, 273, 10**8), changed(several, 257, 5000)]
    both = bytearray(tiff.join_pages([several, page]))
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)] + [(99, changed(both, 273, 10**8))], "id long, data binary")
    out = tiff.pages(df, "data", ["id"]).collect()
    assert len(out) == len(bad) + 2
    assert all(r.error and r.pixels is None for r in out if r.id < 99)
    assert [(r.page, r.pixels is None) for r in sorted(out, key=lambda r: r.page) if r.id == 99] == [(0, True), (1, False)]
    with pytest.raises(ValueError):
        tiff.pages(df.withColumnRenamed("id", "Page"), "data", ["Page"])
