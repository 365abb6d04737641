"""Failure memory: an instance that fails is skipped for a while, and a success clears it.

Attempts come with an instance, a time and whether they would succeed. An attempt is skipped while the last failed attempt of its
instance that was made is less than the cooldown ago; skipped attempts change nothing. Whether an attempt is made thus depends on all
before it, but never across a gap as long as the cooldown: there the memory is empty whatever happened. So the
timeline of an instance is cut at such gaps, and the parts are scanned side by side, each in order of time and with nothing
to remember but one time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECONDS = 600.0
#: Attempts are looked at in buckets of so many cooldowns to find the gaps, so that no task needs a whole instance.
BUCKET = 64


def since(time: str, key: list[str]) -> Column:
    """Microseconds since the attempt before, within a bucket."""
    before = F.lag(time).over(Window.partitionBy(*key).orderBy(time))
    return F.col(time) - before


def stretches(attempts: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """Adds ``stretch``: attempts (instance, at in microseconds) of an instance between two gaps share one.

    The stretch is named by its bucket and place of start. Gaps are found inside buckets of time, and between buckets from their ends.
    """
    wide = int(seconds * 1_000_000)
    b = attempts.withColumn("_bucket", F.floor(F.col("at") / (wide * BUCKET)))
    flagged = b.withColumn("_start", F.coalesce(since("at", ["instance", "_bucket"]) >= wide, F.lit(False)))
    flagged = flagged.withColumn("_part", F.count_if("_start").over(Window.partitionBy("instance", "_bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)))
    ends = b.groupBy("instance", "_bucket").agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    by_time = Window.partitionBy("instance").orderBy("_bucket")
    joined = F.col("_first") - F.lag("_last").over(by_time) < wide
    # a bucket goes on with the stretch of the one before if no gap lies between: its first part takes that one's last name
    parts = flagged.groupBy("instance", "_bucket").agg(F.max("_part").alias("_parts"))
    names = ends.withColumn("_goes_on", F.coalesce(joined, F.lit(False))).join(parts, ["instance", "_bucket"])
    own = F.concat_ws("/", F.col("_bucket").cast("string"), F.col("_parts").cast("string"))
    # the last bucket before that starts a stretch of its own, or has a gap inside, names it
    starts = F.when(~F.col("_goes_on") | (F.col("_parts") > 0), own)
    earlier = F.last(starts, True).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    named = names.select("instance", "_bucket", F.when(F.col("_goes_on"), earlier).otherwise(F.concat_ws("/", F.col("_bucket").cast("string"), F.lit("0"))).alias("_first_name"))
    out = flagged.join(named, ["instance", "_bucket"])
    name = F.when(F.col("_part") == 0, F.col("_first_name")).otherwise(F.concat_ws("/", F.col("_bucket").cast("string"), F.col("_part").cast("string")))
    return out.withColumn("stretch", name).drop("_bucket", "_start", "_part", "_first_name")


def attempted(attempts: DataFrame, key: str, instance: str, time: str, ok: str, seconds: float = SECONDS) -> DataFrame:
    """Rows (key, instance, at, ok, made, until): whether each attempt is made, and until when the instance is skipped after it.

    ``time`` is a timestamp, ``until`` null after a success or where nothing is skipped. Of attempts at one moment the smaller key is first.
    Rows without instance or time are left out; a null ``ok`` is a failure.
    """
    wide = int(seconds * 1_000_000)
    rows = attempts.select(F.col(key).alias("key"), F.col(instance).alias("instance"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.coalesce(F.col(ok), F.lit(False)).alias("ok")).filter("instance IS NOT NULL AND at IS NOT NULL")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, until = None, None
        for batch in batches:
            made, untils = [], []
            for who, stretch, at, good in zip(*(batch.column(i).to_pylist() for i in (1, 4, 2, 3)), strict=True):
                if (who, stretch) != now:
                    now, until = (who, stretch), None
                skipped = until is not None and until > at
                if not skipped:
                    until = None if good else at + wide
                made.append(not skipped)
                untils.append(until)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.bool_()), pa.array(untils, pa.int64())], ["key", "instance", "at", "ok", "made", "until"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    cut = stretches(rows, seconds).select("key", "instance", "at", "ok", "stretch")
    ordered = cut.repartition("instance", "stretch").sortWithinPartitions("instance", "stretch", "at", "key")
    out = ordered.mapInArrow(scan, f"key {kinds['key']}, instance {kinds['instance']}, at bigint, ok boolean, made boolean, until bigint")
    return out.withColumns({"at": F.timestamp_micros("at"), "until": F.timestamp_micros("until")}).withColumnRenamed("key", key)
