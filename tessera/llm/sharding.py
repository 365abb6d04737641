"""Sharding by rendezvous hashing of record keys over weighted shards.

Every pair of a key and a shard has a score of its own: u, a number in (0, 1) from md5("shard:key"), gives the cost
-ln(u) / weight, and a key belongs to the shard of least cost. A shard gets rows in proportion to its weight. Costs do not
depend on how many shards there are, so one more shard takes rows only into itself and one shard less gives away its own
rows only; no table of places is kept and no row is moved to find out.

``shard_of`` is a column: rows are placed where they are read. ``write_shards`` writes a folder a shard, each shard by many
tasks. ``numbered`` gives the rows of each shard gapless numbers in the order of md5(key), then of the columns given.
Groups of a shard and the first three hex digits of md5(key) are numbered on their own, after the rows before them have been
counted, and rows alike are counted instead of gathered, so neither a large shard nor a key that holds a third of all rows
comes to one task.

Defined cases: a null key is placed as an empty string; a null text has no bytes and the crc32 of nothing; an empty text
likewise; texts of any length are read once, by built-in functions; rows with one key go to one shard, whatever their texts;
repeated rows get a slot each; an empty table gives an empty table; weight 0 gets nothing, while negative weights, or none
above 0, are an error; columns of the input that share a name with helpers stay as they are in ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Hex digits of md5 that make u: 52 bits, so that u is exact as a double.
DIGITS = 13
#: Equal rows that one task numbers at a time.
RUN = 100_000


def _key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def cost(key: Column, shard: Column, weight: Column) -> Column:
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", shard.cast("string"), _key(key)).cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return -F.ln((drawn + 0.5) / float(16**DIGITS)) / weight


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key; of equal costs the lower shard wins."""
    if any(w < 0 for w in weights) or not any(w > 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be above 0")
    shards = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights) if w > 0))
    costs = F.transform(shards, lambda s: F.struct(cost(key, s["i"], s["w"]).alias("cost"), s["i"].alias("i")))
    return F.array_min(costs)["i"]


def numbered(rows: DataFrame, key: str, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` and their numbers from 0 within each shard. Columns must be comparable; give keys and figures, not texts.

    Rows that are equal in all columns get numbers that follow each other.
    """
    p, names = common.free_name(rows, "slot"), rows.columns
    placed = rows.groupBy(*names).agg(F.count("*").alias(f"{p} n")).withColumn(f"{p} md5", F.md5(_key(F.col(key)).cast("binary")))
    placed = common.materialise(placed.withColumn(f"{p} bin", F.substring(f"{p} md5", 1, 3)), "shard-rows")
    n = F.sum(f"{p} n")
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    bins = placed.groupBy(shard, f"{p} bin").agg(n.alias(f"{p} n"))  # at most 4,096 a shard
    starts = bins.select(shard, f"{p} bin", F.coalesce(n.over(upto(shard, [f"{p} bin"])), F.lit(0)).alias(f"{p} start"))
    inside = placed.withColumn(f"{p} before", F.coalesce(n.over(upto(shard, f"{p} bin", [f"{p} md5", *names])), F.lit(0)))
    first = F.col(f"{p} start") + F.col(f"{p} before")
    at = inside.join(starts, [shard, f"{p} bin"]).select(*names, first.alias(f"{p} first"), (first + F.col(f"{p} n") - 1).alias(f"{p} last"))
    few = at.filter(F.col(f"{p} last") - F.col(f"{p} first") < RUN)
    many = at.filter(F.col(f"{p} last") - F.col(f"{p} first") >= RUN)
    many = many.withColumn(f"{p} first", F.explode(F.sequence(f"{p} first", f"{p} last", F.lit(RUN).cast("bigint"))))
    many = many.withColumn(f"{p} last", F.least(f"{p} last", F.col(f"{p} first") + RUN - 1)).repartition(*names, f"{p} first")
    each = lambda part: part.select(*names, F.explode(F.sequence(f"{p} first", f"{p} last")).alias(slot))
    return each(few).union(each(many))


def write_shards(docs: DataFrame, path: str, key: str, weights: Sequence[float], files: int = 8) -> DataFrame:
    """Write ``docs`` below ``path`` in a folder ``shard=N`` each, by ``files`` tasks a shard, and return them as stored.

    Rows go to a shard's files by all their columns and by where they were read, so a key with many rows is spread, and so
    are equal rows that come from several parts of the input.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("the table has a column named shard already")
    p = common.free_name(docs, "part")
    part = F.pmod(F.xxhash64(F.spark_partition_id(), *docs.columns), F.lit(files))
    placed = docs.withColumn("shard", shard_of(F.col(key), weights)).withColumn(p, part)
    placed.repartition("shard", p).drop(p).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(f"{docs.schema.toDDL()}, shard int").parquet(path)


# --- the query: 40 shards of equal weight, and where one more would take the rows ----------------------------------

SHARDS = 40


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32) without the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = figures(common.table(spark, sf_dir, "documents"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), [1] * SHARDS)).withColumn("grown_shard", shard_of(F.col("doc_id"), [1] * (SHARDS + 1)))
    return numbered(rows, "doc_id").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")


def _pick(shards: int) -> str:
    drawn = f"('0x' || substr(md5(s || ':' || k), 1, {DIGITS}))::BIGINT"
    return f"(list_min(list_transform(range({shards}), lambda s: {{'cost': -ln(({drawn} + 0.5) / {float(16**DIGITS)}), 'i': s}}))).i::INTEGER"


#: DuckDB has no crc32: its table is made from the polynomial, and the bytes of a text are folded through it.
CRC_TABLE = "list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"

ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
b AS (SELECT doc_id, k, strlen(t)::BIGINT + 16 AS size, bytes, {CRC_TABLE} AS crc_table FROM d),
s AS (SELECT doc_id, k, size, {CRC} AS text_crc32, {_pick(SHARDS)} AS shard, {_pick(SHARDS + 1)} AS grown_shard FROM b)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s
"""
