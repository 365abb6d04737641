import random
import zlib

import numpy as np
import pytest

from tessera.llm import common, quality, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    n1 = int(label.sum())
    return (rank[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize("query, label, least, cut", [(quality.op5_quality, "quality", 0.97, 0.3), (toxicity.op4_toxicity, "toxic", 0.93, 0.5)])
def test_held_out(spark, query, label, least, cut):
    got = query(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= cut)).all()
    held = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert auc(held.score.to_numpy(), held[label].to_numpy()) > least


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"good{i % 7} words here" if i % 2 else "bad### bad###") for i in range(200)], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    right = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    wrong = spark.createDataFrame([(i, i % 2 if not held(i) else 1 - i % 2, 1 - i % 2 if not held(i) else i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    a, b = (quality.train(docs, x).compact() for x in (right, wrong))
    assert (a[0] == b[0]).all() and a[1] == b[1]
    a, b = (toxicity.train(docs, x) for x in (right, wrong))
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_edge_rows(spark):
    rows = [(1, None, 0.5), (1, "", 0.5), (None, " \n ", 0.5), (2, "ok " * 200_000, 0.5), (2, "x" * 300_000, 0.5), (3, "퟿ é 😀", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score > 0.99 for r in quality.score(docs, quality.train(docs, none)).collect()} == {True}
    assert {r.score < 0.5 for r in toxicity.score(docs, *toxicity.train(docs, none)).collect()} == {True}
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, none)).count() == 0
    assert toxicity.score(empty, *toxicity.train(empty, none)).count() == 0


def test_scoring_by_word_equals_the_model():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab abc### xyz q x x Éé".split()) for _ in range(rng.randrange(0, 30))) for _ in range(120)]
    model = quality.SubwordModel().fit(texts, [int("###" not in t) for t in texts])
    values, bias = model.compact()
    scorer = quality.WordScorer(values, model.grams)
    together = scorer.means(texts) + bias
    alone = np.concatenate([quality.WordScorer(values, model.grams).means([t]) for t in texts]) + bias
    assert np.allclose(together, alone)


def test_bounded_sample(spark):
    df = spark.range(5000)
    assert common.bounded_sample(df, "id", 6000).count() == 5000
    assert 700 < common.bounded_sample(df, "id", 1000).count() < 1300


def test_repeated_ids_do_not_unbind_the_sample(spark):
    docs = spark.range(5000).selectExpr("if(id < 4800, 7, id) AS doc_id", "concat('text ', id) AS text")
    all_rows = common.bounded_texts(docs, 5000)
    assert all_rows.count() == 5000
    assert 50 < common.bounded_texts(docs, 100).count() <= 200
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert 300 < common.bounded_texts(docs, 5000, size // 10).count() < 700
    same = spark.range(5000).selectExpr("CAST(NULL AS long) AS doc_id", "CAST(NULL AS string) AS text")
    assert common.bounded_texts(same, 100).count() <= 200
    assert common.bounded_texts(docs.limit(0), 100).count() == 0
    labels = spark.createDataFrame([(7, 1, 1), (4801, 0, 0), (4803, 1, 0)], "doc_id long, quality int, toxic int")
    a, b = (quality.train(docs, labels, limit=10).compact() for _ in range(2))
    assert (a[0] == b[0]).all() and a[1] == b[1]
    weights, bias = toxicity.train(docs, labels, n_toxic=10, n_unlabelled=10)
    assert np.isfinite(weights).all() and np.isfinite(bias)
