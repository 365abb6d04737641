import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding as S


def brute(key, weights):
    k = "" if key is None else str(key)
    u = lambda i: (int(hashlib.md5(f"{i}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    return min((-math.log(u(i)) / w, i) for i, w in enumerate(weights) if w > 0)[1]


def slots(rows):
    """Numbers by shard in the order of md5(key) and the row; rows are (shard, key, ...)."""
    out, seen = [], Counter()
    none_first = lambda v: (v is not None, v if v is not None else 0)
    for r in sorted(rows, key=lambda r: (r[0], hashlib.md5(("" if r[1] is None else str(r[1])).encode()).hexdigest(), *map(none_first, r[1:]))):
        out.append((*r, seen[r[0]]))
        seen[r[0]] += 1
    return out


def test_places_equal_brute_force_and_follow_the_weights(spark):
    weights = [1, 2.5, 0, 4, 0.5]
    rows = spark.range(8000).select(F.col("id").alias("k"), S.shard_of(F.col("id"), weights).alias("s"), S.shard_of(F.col("id"), [*weights, 2]).alias("more"), S.shard_of(F.col("id"), weights[:-1]).alias("less")).collect()
    assert all(r.s == brute(r.k, weights) for r in rows[:500])
    share = Counter(r.s for r in rows)
    assert 2 not in share and all(abs(share[i] / 8000 - w / 8) < 0.02 for i, w in enumerate(weights))
    assert all(r.more in (r.s, 5) for r in rows) and abs(sum(r.more == 5 for r in rows) / 8000 - 0.2) < 0.02  # only into the new shard, and its share
    assert all(r.less == r.s for r in rows if r.s != 4)  # only out of the shard that went


@pytest.mark.parametrize("weights", [[], [0, 0], [1, -1]])
def test_weights_are_checked(weights):
    with pytest.raises(ValueError):
        S.shard_of(F.col("k"), weights)


def test_edge_rows_get_slots_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN", 7)  # so that the repeated rows are dealt to several tasks
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 3, 40, 500]), rng.choice(["a", "", None, "b" * 50_000])) for _ in range(300)] + [(7, "same")] * 150 + [(None, None), (None, "x"), (9, None)]
    df = spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, text string, shard string")
    held = S.figures(df)
    want = [(brute(d, [1] * 3), d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows]
    placed = held.withColumn("shard", S.shard_of(F.col("doc_id"), [1] * 3)).withColumn("slot md5", F.lit(1))  # a name that a helper would like
    got = [(r.shard, r.doc_id, r.size, r.text_crc32, r.slot) for r in S.numbered(placed, "doc_id").collect()]
    assert sorted(got, key=repr) == sorted(slots(want), key=repr)
    assert S.numbered(placed.limit(0), "doc_id").count() == 0


def test_written_shards_hold_every_row_in_its_folder(spark, tmp_path):
    rows = [(i % 97, f"t{i % 300}", i % 5) for i in range(2000)] + [(None, None, 1), (3, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    back = S.write_shards(df, str(tmp_path / "s"), "doc_id", [1, 2, 1], files=3)
    assert sorted(back.drop("shard").collect(), key=repr) == sorted(df.collect(), key=repr) and back.columns == [*df.columns, "shard"]
    assert all(r.shard == brute(r.doc_id, [1, 2, 1]) for r in back.select("doc_id", "shard").distinct().collect())
    assert all(f"shard={r.shard}/" in r.f for r in back.select("shard", F.input_file_name().alias("f")).collect())
    with pytest.raises(ValueError):
        S.write_shards(df.withColumn("SHARD", F.lit(1)), str(tmp_path / "t"), "doc_id", [1])


def test_query_over_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = S.op13_sharding(spark, sf_dir).collect()
    want = [(brute(d.doc_id, [1] * 40), d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs]
    assert sorted((r.shard, r.doc_id, r.size, r.text_crc32, r.slot) for r in got) == sorted(slots(want))
    assert all(r.grown_shard == brute(r.doc_id, [1] * 41) and r.law == "key" for r in got)
