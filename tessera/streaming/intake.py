"""Candidates that arrive as a stream: the first of each domain within the watermark goes on, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import urls


def first_seen(stream: DataFrame, url: str = "url", time: str = "ts", wait: str = "1 day") -> DataFrame:
    """Adds the domain, drops blocked ones, and keeps one event for each domain while the watermark remembers it."""
    named = stream.withColumn("domain", urls.domain(F.col(url))).filter(~urls.blocked_domain(F.col("domain")))
    return named.withWatermark(time, wait).dropDuplicatesWithinWatermark(["domain"])


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to ``handle``, which must accept a batch again after a failure."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
