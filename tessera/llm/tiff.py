"""TIFF columns: walk image directories, decode strips and tiles, undo predictors, one row per page.

Read: both byte orders, strips and tiles, no compression, PackBits, LZW and deflate, horizontal differencing,
8 or 16 bits a sample, chunky samples. Written (for round trips): 8-bit grey pages with any of these codecs.
Each page also gets figures of its samples: least, greatest, sum, and how many differ from their left neighbour.

Defined cases: a null value gives no page; a value that is not a readable TIFF gives one row with page null and the
reason in ``error``; a page that fails in whatever way (sizes of zero, fields that point beyond the file, blocks that are
short, too few or absent, more samples than the stored bytes can hold) gives its row with null pixels and the reason,
and the other pages are still read; directories that point back at themselves or beyond the file end the walk; repeated
rows and ids give their own pages; an empty table gives an empty table; of other columns only those named in ``keep`` are
carried, and a name that a page column has too raises ValueError. Pages may be of any size that fits a binary value.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CODECS = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
#: Sizes of the field types of TIFF 6.0, and the letters of struct for the whole numbers among them.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


# --- codecs -----------------------------------------------------------------------------------------------------


def unpack_bits(data: bytes, most: int = 1 << 31) -> bytes:
    """At least ``most`` bytes of the content, if it has as many."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        else:
            if k > 128:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 2 if k > 128 else 1
    return bytes(out)


RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more are repeated bytes; all else is literal."""
    out, at = bytearray(), 0
    for run in [*RUN.finditer(data), None]:
        literal = data[at : run.start() if run else len(data)]
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out += part
        if run:
            out += bytes((257 - len(run[0]), run[0][0]))
            at = run.end()
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early; the table is cleared before it is full."""
    table: dict[int, int] = {}  # code of a word and the byte behind it -> code of the longer word
    width, bits, held, following = 9, 256, 9, 258  # begins with a clear code
    out, word = bytearray(), -1
    for b in data:
        if word < 0:
            word = b
            continue
        longer = word << 8 | b
        code = table.get(longer)
        if code is not None:
            word = code
            continue
        bits, held = bits << width | word, held + width
        table[longer], word = following, b
        following += 1
        if following == 4094:
            bits, held = bits << width | 256, held + width
            table.clear()
            width, following = 9, 258
        elif following > (1 << width) - 1:
            width += 1
        if held >= 1024:
            rest = held % 8
            out += (bits >> rest).to_bytes(held // 8, "big")
            bits, held = bits & ((1 << rest) - 1), rest
    if word >= 0:
        bits, held = bits << width | word, held + width
        if following + 1 > (1 << width) - 1 and width < 12:
            width += 1
    bits, held = bits << width | 257, held + width
    pad = -held % 8
    return bytes(out + (bits << pad).to_bytes((held + pad) // 8, "big"))


def lzw_decode(data: bytes, most: int = 1 << 31) -> bytes:
    """At least ``most`` bytes of the content, if it has as many."""
    words = [bytes([b]) for b in range(256)] + [b"", b""]
    table, width, bits, held, last, out = list(words), 9, 0, 0, b"", bytearray()
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(words), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out += word
        if len(out) >= most:
            break
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def compress(data: bytes, codec: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}[codec](data)


#: How many bytes one stored byte can stand for.
GROWTH = {NONE: 1, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 128}


def expand(data: bytes, codec: int, most: int = 1 << 31) -> bytes:
    """The content of a block; of one that holds more than ``most`` bytes at least the first ``most``."""
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    return {NONE: lambda d, n: bytes(d[:n]), LZW: lzw_decode, PACKBITS: unpack_bits}[codec](data, most)


# --- files ------------------------------------------------------------------------------------------------------


def write_page(pixels: bytes, width: int, codec: int = DEFLATE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 1024) -> bytes:
    """A little-endian file with one page of 8-bit grey samples; tile: the side of square tiles, else strips."""
    image = np.frombuffer(pixels, np.uint8).reshape(-1, width)
    height = len(image)
    if tile:
        across, down = -(-width // tile), -(-height // tile)
        padded = np.zeros((down * tile, across * tile), np.uint8)
        padded[:height, :width] = image
        blocks = [padded[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile] for r in range(down) for c in range(across)]
    else:
        blocks = [image[r : r + rows_per_strip] for r in range(0, height, rows_per_strip)]
    if predictor == 2:
        blocks = [np.diff(b, axis=1, prepend=np.uint8(0)) for b in blocks]
    coded = [compress(np.ascontiguousarray(b).tobytes(), codec) for b in blocks]
    fields = [(256, width), (257, height), (258, 8), (259, codec), (262, 1), (277, 1), (317, predictor)]
    places, sizes = (324, 325) if tile else (273, 279)
    fields += [(322, tile), (323, tile)] if tile else [(278, rows_per_strip)]
    n = len(coded)
    body_at = 8
    offsets, at = [], body_at
    for c in coded:
        offsets.append(at)
        at += len(c)
    pad = at % 2
    lists_at = at + pad
    extra = b"" if n == 1 else struct.pack(f"<{n}I", *offsets) + struct.pack(f"<{n}I", *map(len, coded))
    fields += [(places, offsets[0] if n == 1 else lists_at), (sizes, len(coded[0]) if n == 1 else lists_at + 4 * n)]
    fields.sort()
    entries = b"".join(struct.pack("<HHII", tag, 4, n if tag in (places, sizes) else 1, value) for tag, value in fields)
    ifd_at = lists_at + len(extra)
    return struct.pack("<2sHI", b"II", 42, ifd_at) + b"".join(coded) + b"\0" * pad + extra + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0)


def join_pages(files: list[bytes]) -> bytes:
    """One file with the pages of several that ``write_page`` made."""
    out = bytearray(files[0])
    for f in files[1:]:
        out += b"\0" * (len(out) % 2)
        shift = len(out) - 8
        (ifd,) = struct.unpack_from("<I", f, 4)
        body = bytearray(f[8:])
        (count,) = struct.unpack_from("<H", f, ifd)
        for k in range(count):
            at = ifd + 2 + 12 * k
            tag, _, n, value = struct.unpack_from("<HHII", f, at)
            if tag in (273, 324) or tag in (279, 325) and n > 1:
                struct.pack_into("<I", body, at, value + shift)
            if tag in (273, 324) and n > 1:
                struct.pack_into(f"<{n}I", body, value - 8, *(v + shift for v in struct.unpack_from(f"<{n}I", f, value)))
        last = struct.unpack_from("<I", out, 4)[0]
        while True:
            (count,) = struct.unpack_from("<H", out, last)
            link = last + 2 + 12 * count
            (following,) = struct.unpack_from("<I", out, link)
            if not following:
                break
            last = following
        struct.pack_into("<I", out, link, ifd + shift)
        out += body
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The fields of each page in file order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        (count,) = struct.unpack_from(order + "H", data, at)
        fields: dict[int, tuple] = {0: (order,)}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in LETTERS:
                continue
            place = at + 10 + 12 * k
            if SIZES[kind] * n > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + SIZES[kind] * n <= len(data):  # else the page lacks the field
                fields[tag] = struct.unpack_from(f"{order}{n}{LETTERS[kind]}", data, place)
        yield fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)


def read_page(data: bytes, fields: dict[int, tuple]) -> tuple[dict, bytes]:
    """The page's figures and its samples, row by row, in the file's byte order undone to little-endian."""
    one = lambda tag, default=0: (fields.get(tag) or (default,))[0]
    order, width, height = fields[0][0], one(256), one(257)
    codec, predictor, per = one(259, NONE), one(317, 1), one(277, 1)
    bits = one(258, 1)
    facts = {"width": width, "height": height, "bits": bits, "samples": per, "codec": CODECS.get(codec, str(codec)), "predictor": predictor}
    if codec not in CODECS:
        raise ValueError(f"compression {codec} is not supported")
    if bits not in (8, 16) or one(284, 1) != 1 or predictor not in (1, 2):
        raise ValueError("only chunky samples of 8 or 16 bits, with predictor 1 or 2, are supported")
    kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
    tiled = 324 in fields
    block_w, block_h = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    if min(width, height, per, block_w, block_h) < 1:
        raise ValueError("a size is absent or not positive")
    places, sizes = fields.get(324 if tiled else 273, ()), fields.get(325 if tiled else 279, ())
    across, down = -(-width // block_w), -(-height // block_h)
    if len(places) != len(sizes) or len(places) < across * down:
        raise ValueError("blocks are missing")
    need = width * height * per * kind.itemsize
    if need >= 1 << 31 or need > GROWTH[codec] * sum(sizes[: across * down]):
        raise ValueError("more samples than a value or the stored bytes can hold")
    facts["blocks"] = len(places)
    image = np.zeros((height, width, per), kind.newbyteorder("<"))
    for k, (place, n) in enumerate(zip(places[: across * down], sizes, strict=False)):
        top, left = k // across * block_h, k % across * block_w
        rows = block_h if tiled else min(block_h, height - top)
        if place + n > len(data):
            raise ValueError("a block lies beyond the file")
        full = rows * block_w * per * kind.itemsize
        if full > GROWTH[codec] * n:
            raise ValueError("a block is too short")
        raw = expand(data[place : place + n], codec, full)
        if len(raw) < full:
            raise ValueError("a block is too short")
        block = np.frombuffer(raw, kind, rows * block_w * per).reshape(rows, block_w, per).astype(kind.newbyteorder("<"))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        part = block[: height - top, : width - left]
        image[top : top + len(part), left : left + part.shape[1]] = part
    facts |= {"least": int(image.min()), "greatest": int(image.max()), "total": int(image.sum(dtype=np.int64)), "changes": int((image[:, 1:] != image[:, :-1]).sum())}
    return facts, image.tobytes()


PAGE = "page int, width int, height int, bits int, samples int, codec string, predictor int, blocks int, least int, greatest int, total bigint, changes bigint, pixels binary, error string"


def pages(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """One row per page of each file in column ``content``, with the columns in ``keep``."""
    common.small_batches(df.sparkSession)
    names = [x.split()[0] for x in PAGE.split(", ")]
    if clash := {k.lower() for k in keep} & set(names):
        raise ValueError(f"columns that a page has too: {sorted(clash)}")
    page_schema = pa.schema([(n, {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[t]) for n, t in (x.split() for x in PAGE.split(", "))])

    def read(data: bytes) -> list[dict]:
        out, page = [], 0
        try:
            for fields in directories(data):
                row = {"page": page}
                try:
                    facts, pixels = read_page(data, fields)
                    row |= facts | {"pixels": pixels}
                except Exception as e:  # noqa: BLE001  whatever is wrong with a page is its row's error
                    row |= {"error": f"{type(e).__name__}: {e}"[:200]}
                out.append(row)
                page += 1
        except (ValueError, struct.error) as e:
            out.append({"error": str(e)[:200]})
        return out

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, row) for i, data in enumerate(batch.column(len(keep)).to_pylist()) if data is not None for row in read(data)]
            kept = pa.Table.from_batches([batch]).select(range(len(keep))).take(pa.array([i for i, _ in found], pa.int64()))
            rows = [pa.array([r.get(n) for _, r in found], page_schema.field(n).type) for n in names]
            yield from pa.Table.from_arrays([*kept.columns, *rows], [*keep, *names]).to_batches()

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, content).mapInArrow(walk, f"{schema}, {PAGE}")


def store_bytes(data: bytes, width: int = 64) -> bytes:
    """Bytes, zero-filled to a positive multiple of ``width``, as one grey page.

    The checksum of the bytes picks one of five forms, so that all codecs meet texts of all sizes: stored plainly, LZW,
    PackBits, deflate in strips, and deflate in tiles; the last two and LZW with differencing.
    """
    payload = data + b"\0" * (-len(data) % width or (0 if data else width))
    codec, predictor, tile = ((NONE, 1, 0), (LZW, 2, 0), (PACKBITS, 1, 0), (DEFLATE, 2, 0), (DEFLATE, 2, width))[zlib.crc32(payload) % 5]
    return write_page(payload, width, codec, predictor, tile, rows_per_strip=128)


def encode(df: DataFrame, content: str, keep: list[str], out: str = "tiff") -> DataFrame:
    """Column ``content`` (binary; null: empty) of each row as a TIFF in column ``out``, with the columns in ``keep``."""
    common.small_batches(df.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [store_bytes(d or b"") for d in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(files, pa.binary())], [*keep, out])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, content).mapInArrow(store, f"{schema}, `{out}` binary")


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    stored = encode(docs.withColumn("n_bytes", F.octet_length("bytes").cast("bigint")), "bytes", ["doc_id", "n_bytes"])
    # the file's digest goes along before the file itself is taken apart
    stored = stored.withColumns({"media_bytes": F.octet_length("tiff").cast("bigint"), "media_sha256": F.sha2("tiff", 256)})
    read = pages(stored, "tiff", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return read.select(
        "doc_id", "n_bytes",
        F.octet_length("pixels").cast("bigint").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        "media_bytes", "media_sha256",
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "codec", F.concat(F.lit("p"), "predictor"), F.concat(F.lit("b"), "blocks"), F.concat_ws("-", "least", "greatest"), "total", "changes").alias("feature"),
    )
