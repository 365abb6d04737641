"""Small helpers that the text operators share: scratch tables, batch sizes, folds, what a worker process remembers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to Python, so that a batch of very long texts still fits a worker. The same
#: for all operators, since the setting in force is the session's when a plan runs, not when it was made.
BATCH_ROWS, BATCH_BYTES = 1_000, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; rows are bounded too since list columns are cheap to count."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_worker: dict[str, Any] = {}


def release() -> None:
    """Drop what this worker process remembers and give its free memory back; operators that remember nothing call this as they start."""
    if _worker.get("released"):
        return
    _worker.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
        trim(0)
    _worker["released"] = True


def remembered(key: str, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task: one thing at a time, so that operators do not add up in its memory."""
    if key not in _worker:
        release()
        _worker.clear()
        _worker[key] = make()
    return _worker[key]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local master (tests) may leave that unset and gets a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it again: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.scratch_path = path
    return held


def forget(*tables: DataFrame) -> None:
    """Remove the files of materialised tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows of ids that are sent to every task instead of shuffling what they select from.
BROADCAST_IDS = 1_000_000


def semi_by_id(df: DataFrame, ids: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``ids`` (or is not: left_anti): by broadcast where their number, counted first,
    allows it, else by a shuffle."""
    ids = ids.select(on).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on, how)


def free_name(df: DataFrame, name: str) -> str:
    """A beginning for helper columns that no column of ``df`` has, whatever its case."""
    while any(c.lower().startswith(name) for c in df.columns):
        name = f"_{name}"
    return name


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out from every training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """All rows if there are at most ``limit``, else those whose key, with the row's copies of it, hashes low enough to leave
    about ``limit`` rows, and never more than twice ``limit``: of rows that share a key (a null id, say) beyond that, the rest goes.

    The same rows on every run as long as no key repeats that often; no task or driver ever holds more than the sample.
    """
    n = df.count()
    if n <= limit:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 40)) < int(limit / n * (1 << 40))).limit(2 * limit)


#: Most bytes of text, about, that a model is fitted on.
SAMPLE_BYTES = 256 << 20


def bounded_texts(df: DataFrame, limit: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The rows of a sample already joined with ``doc_id`` and ``text``: all if they are at most ``limit`` with at most ``most_bytes``
    of text, else those whose id and text hash low enough to leave about as much, and never more than twice ``limit`` rows.

    A sample of ids is no bound by itself, since each row of a repeated id comes along.
    """
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, limit / max(n, 1), most_bytes / max(size, 1))
    if share == 1:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(13), "doc_id", "text"), F.lit(1 << 40)) < int(share * (1 << 40))).limit(2 * limit)
