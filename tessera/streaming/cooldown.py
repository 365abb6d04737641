"""The failure memory of ``operators.cooldown`` over a stream: one time of state for each instance, forgotten when it has passed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.cooldown import SECONDS


def attempted(stream: DataFrame, key: str, instance: str, time: str, ok: str, seconds: float = SECONDS, late: str = "0 seconds") -> DataFrame:
    """Rows (key, instance, at, ok, made, until) as ``operators.cooldown.attempted`` gives them, as far as attempts arrive in order of time.

    Attempts of one micro-batch are put in order; one that arrives later than a newer one is judged by what is known then, and
    one later than the watermark is dropped. The state of an instance goes once the watermark passes the end of its cooldown.
    """
    wide = int(seconds * 1_000_000)
    rows = stream.select(F.col(key).alias("key"), F.col(instance).alias("instance"), F.col(time).cast("timestamp").alias("time"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"))
    rows = rows.filter("instance IS NOT NULL AND time IS NOT NULL").withColumn("at", F.unix_micros("time")).withWatermark("time", late)

    def judge(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        batch = pd.concat(list(batches)).sort_values(["at", "key"])  # one instance's attempts of one micro-batch
        made, untils = [], []
        for at, good in zip(batch["at"].tolist(), batch["ok"].tolist(), strict=True):
            skipped = until is not None and until > at
            if not skipped:
                until = None if good else at + wide
            made.append(not skipped)
            untils.append(until)
        yield batch[["key", "instance", "at", "ok"]].assign(made=made, until=pd.array(untils, "Int64"))
        if until is None:
            state.remove()
        else:
            state.update((until,))
            state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.groupBy("instance").applyInPandasWithState(judge, f"key {kinds['key']}, instance {kinds['instance']}, at bigint, ok boolean, made boolean, until bigint", "until bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({"at": F.timestamp_micros("at"), "until": F.timestamp_micros("until")}).withColumnRenamed("key", key)
