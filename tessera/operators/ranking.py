"""First-wins deduplication, caps and rankings: windows with explicit orders, so that every run gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import placed


def top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Catalyst limits every task to n rows a key before the shuffle."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_place") <= n).drop("_place")


def first_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row of each key, the first by ``order``; rows without a key are dropped."""
    return top(df.filter(F.coalesce(F.col(key), F.lit("")) != ""), [key], order)


def candidate_union(channels: list[DataFrame], key: str = "domain") -> DataFrame:
    """Candidates of several channels, each with a position; earlier channels win."""
    placed = [df.withColumn("channel_place", F.lit(i)) for i, df in enumerate(channels)]
    union = placed[0]
    for df in placed[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    return first_wins(union, key, [F.col("channel_place"), F.col("pos")])


def pool_cap(limit: int) -> int:
    """How many candidates are looked at for ``limit`` results."""
    return min(max(2 * limit, limit + 8), 40)


def people_rank(df: DataFrame, limit: int, tie: str) -> DataFrame:
    scores = ("lead_score", "contact_score", "icp_score", "personalization_score")
    return df.orderBy(*(F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(0)).desc() for c in scores), tie).limit(limit)


def banded_rank(df: DataFrame, limit: int, tie: str) -> DataFrame:
    """At most ``limit`` verified rows and as many others, of which those to review come before rejected ones; ``place`` orders all."""
    band = F.when(F.col("match_confidence") == "verified", 0).when(F.col("match_confidence") == "review", 1).otherwise(2)
    banded = df.withColumn("_band", band).withColumn("_rest", F.col("_band") > 0)
    order = [F.col("_band"), F.col("lead_score").cast("int").desc(), F.col(tie)]
    kept = banded.orderBy(*order).filter(~F.col("_rest")).limit(limit).unionByName(banded.filter("_rest").orderBy(*order).limit(limit))
    return kept.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("_band", "_rest")  # two limits bound this window


def interleave(df: DataFrame, key: str = "text", lane: str = "lane", pos: str = "pos") -> DataFrame:
    """Rows of several lanes in turn, each text once; ``place`` orders them. Positions should not repeat within a lane.

    Neither a long lane nor a lane's many turns come to one task: places within a lane come from places among all rows.
    """
    all_ = placed(df, [F.col(lane), F.col(pos), F.col(key)], "_at")
    starts = all_.groupBy(lane).agg(F.min("_at").alias("_first"))
    turn = all_.join(starts, lane).withColumn("_turn", F.col("_at") - F.col("_first"))
    kept = top(turn, [key], [F.col("_turn"), F.col(lane)])
    return placed(kept.select(key, lane, "_turn"), [F.col("_turn"), F.col(lane)]).select(F.col("place").cast("int").alias("place"), key)
