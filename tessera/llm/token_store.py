"""Token ids in directly addressable codes (DAC).

Every id is split into chunks of ``width`` bits. Level 0 holds the lowest chunk of every id, level 1 the
next chunk of those ids that need one, and so on. A bitmap per level says which ids continue, and a rank
directory (ones before each block of 512 bits) turns a position in one level into a position in the next,
so that any token is read without decoding the tokens before it.

A segment is one binary value that holds whole documents in ascending id order, at least one and otherwise
up to ``segment_tokens`` ids. Segments are rows of a table written by Spark, which is what commits them
once even if a task runs twice or an executor is lost.

Defined cases: a null text is an empty text and gets the end id only; a null id sorts first and is kept;
repeated ids and repeated rows are all kept, ordered by text; an empty table gives an empty table; other
columns of the input are left out whatever their names; a text of any length goes to one segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.word_cache import CachedEncoder

MAGIC = b"DACT"
BLOCK_BITS = 512
SEGMENT_TOKENS = 1 << 18


def pack_levels(ids: np.ndarray, width: int = 8) -> bytes:
    """Unsigned ids below 2**32 as DAC levels."""
    if width not in (4, 8, 16):
        raise ValueError("width must be 4, 8 or 16")
    rest, levels = ids.astype(np.uint32), []
    while True:
        low, rest = rest & np.uint32((1 << width) - 1), rest >> np.uint32(width)
        more = rest > 0
        levels.append((low, more))
        if not more.any():
            break
        rest = rest[more]
    parts = [struct.pack("<BB", width, len(levels))]
    for low, more in levels:
        if width == 4:
            nibbles = np.concatenate([low, np.zeros(len(low) % 2, np.uint32)]).astype(np.uint8)
            chunks = (nibbles[0::2] | (nibbles[1::2] << 4)).tobytes()
        else:
            chunks = low.astype("<u2" if width == 16 else np.uint8).tobytes()
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        parts += [struct.pack("<QQQ", len(low), len(chunks), len(ranks)), chunks, bits.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class Levels:
    """Reads packed levels: ``ids[i]`` by rank, ``all()`` in one pass."""

    def __init__(self, data: bytes, at: int = 0):
        self.width, count = struct.unpack_from("<BB", data, at)
        at += 2
        self.levels = []
        for _ in range(count):
            n, n_chunk, n_rank = struct.unpack_from("<QQQ", data, at)
            at += 24
            chunks = np.frombuffer(data, "<u2" if self.width == 16 else np.uint8, n_chunk // (2 if self.width == 16 else 1), at)
            at += n_chunk
            bits = np.frombuffer(data, np.uint8, n_rank * BLOCK_BITS // 8, at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", n_rank, at)
            at += 4 * n_rank
            self.levels.append((n, chunks, bits, ranks))
        self.end = at

    def __len__(self) -> int:
        return self.levels[0][0]

    def _chunk(self, chunks: np.ndarray, i: int) -> int:
        return int(chunks[i]) if self.width != 4 else int(chunks[i >> 1]) >> (4 * (i & 1)) & 15

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for _, chunks, bits, ranks in self.levels:
            value |= self._chunk(chunks, i) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            first = block * (BLOCK_BITS // 8)
            before = int(np.bitwise_count(bits[first : i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i, shift = int(ranks[block]) + before, shift + self.width
        return value

    def all(self) -> np.ndarray:
        upper = np.zeros(0, np.uint32)
        for n, chunks, bits, _ in reversed(self.levels):
            if self.width == 4:
                chunks = np.stack([chunks & 15, chunks >> 4], axis=1).ravel()[:n]
            value = chunks.astype(np.uint32)
            value[np.unpackbits(bits, count=n, bitorder="little").astype(bool)] |= upper << np.uint32(self.width)
            upper = value
        return upper


def pack_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int = 8) -> bytes:
    nulls = np.packbits([d is None for d in doc_ids], bitorder="little").tobytes()
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    head = struct.pack("<4sQQ", MAGIC, len(doc_ids), len(nulls))
    return head + nulls + keys + np.asarray(lengths, "<u8").tobytes() + pack_levels(ids, width)


class Segment:
    """One stored segment: document ids, their lengths and their tokens."""

    def __init__(self, data: bytes):
        magic, n, n_nulls = struct.unpack_from("<4sQQ", data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = struct.calcsize("<4sQQ")
        null = np.unpackbits(np.frombuffer(data, np.uint8, n_nulls, at), count=n, bitorder="little")
        keys = np.frombuffer(data, "<i8", n, at := at + n_nulls)
        self.lengths = np.frombuffer(data, "<u8", n, at := at + 8 * n).astype(np.int64)
        self.doc_ids = [None if gone else int(k) for gone, k in zip(null, keys, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.tokens = Levels(data, at + 8 * n)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, segment_tokens: int = SEGMENT_TOKENS, width: int = 8) -> DataFrame:
    """Rows (part int, seg int, first_id bigint, n_docs bigint, n_tokens bigint, body binary), ordered by part and seg.

    One range shuffle on the id puts documents in order; each task then streams its range into segments.
    """
    common.small_batches(docs.sparkSession)
    ranged = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = common.remembered(f"encoder {tokenizer}", lambda: CachedEncoder(tokenizer)), end_id.to_bytes(4, "little")
        part, seg, held, n_held = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            keys, ids, lengths = sum((k for k, _, _ in held), []), np.concatenate([i for _, i, _ in held]), np.concatenate([n for _, _, n in held])
            body = pack_segment(keys, lengths, ids, width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([keys[0]], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([body], pa.binary())], ["part", "seg", "first_id", "n_docs", "n_tokens", "body"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            coded = [encoder.encode(t) + end for t in batch.column(1).to_pylist()]
            lengths = np.array([len(c) for c in coded], np.int64) // 4
            ids = np.frombuffer(b"".join(coded), "<u4")
            ends, first = np.cumsum(lengths), 0
            while first < len(keys):
                base = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + segment_tokens - n_held, "right")))
                if n_held and ends[last - 1] - base + n_held > segment_tokens:
                    yield row()
                    seg, held, n_held = seg + 1, [], 0
                    continue
                held.append((keys[first:last], ids[base : ends[last - 1]], lengths[first:last]))
                n_held += int(ends[last - 1] - base)
                first = last
                if n_held >= segment_tokens:
                    yield row()
                    seg, held, n_held = seg + 1, [], 0
        if held:
            yield row()

    return ranged.mapInArrow(pack, "part int, seg int, first_id bigint, n_docs bigint, n_tokens bigint, body binary")


def write_store(docs: DataFrame, path: str, tokenizer: str, **options) -> DataFrame:
    """Write the segments of ``docs`` below ``path`` and return them as stored."""
    encode_documents(docs, tokenizer, **options).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def read_documents(store: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read back from the stored segments.

    ``start`` is a prefix sum in three steps (within a segment, over the segments of a part, over the parts), so no
    task sees more than one part's segment sizes or one row per part.
    """
    common.small_batches(store.sparkSession)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seg, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = Segment(body)
                raw = memoryview(s.tokens.all().astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(s.starts[:-1].tolist(), s.starts[1:].tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seg] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.starts[:-1]), pa.array(s.lengths), pa.array(crcs, pa.int64())], ["part", "seg", "doc_id", "local", "n_tokens", "ids_crc32"])

    docs = store.select("part", "seg", "body").mapInArrow(unpack, "part int, seg int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = store.select("part", "seg", "n_tokens")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("part_start"))
    segs = sizes.select("part", "seg", F.coalesce(F.sum("n_tokens").over(before("part", "seg")), F.lit(0)).alias("seg_start")).join(parts, "part")
    return docs.join(segs, ["part", "seg"]).select("doc_id", (F.col("part_start") + F.col("seg_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_store(common.table(spark, sf_dir, "documents"), common.scratch(spark, "tokens"), tokenizer_path())
    return read_documents(store)
