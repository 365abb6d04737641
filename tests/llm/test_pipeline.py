import hashlib
import zlib

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from tessera.llm import common, mixing, quality, token_store

from test_decontaminate import brute as leaks
from test_decontaminate import words
from test_ngram_join import brute as components


def test_every_stage_equals_its_plain_version(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        tables[name] = (docs, docs := common.materialise(stage(spark, docs, sf_dir), name))
    before = {name: {r.doc_id: r for r in a.collect()} for name, (a, _) in tables.items()}
    after = {name: {r.doc_id: r for r in b.collect()} for name, (_, b) in tables.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == list(tables) and all(b.columns == columns for n, (_, b) in tables.items() if n != "token_ids")

    # quality: the model's own scores decide
    model = quality.train(tables["quality"][0], common.table(spark, sf_dir, "labels"))
    values, bias = model.compact()
    rows = list(before["quality"].values())
    z = quality.WordScorer(values, model.grams).means([r.text for r in rows]) + bias
    assert after["quality"].keys() == {r.doc_id for r, x in zip(rows, z, strict=True) if 1 / (1 + np.exp(-x)) >= 0.3}

    rows = before["near_duplicates"]
    assert after["near_duplicates"].keys() == {d for d, _, c in components([(d, r.text) for d, r in rows.items()]) if c == d}

    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    rows = before["decontaminate"]
    assert after["decontaminate"].keys() == rows.keys() - {d for d, _ in leaks([(d, r.text) for d, r in rows.items()], items)}

    rows, leaves = before["mixing"], {}
    for d, r in rows.items():
        n = int("".join(c for c in r.source if c.isdigit()))
        leaves.setdefault(("code" if n >= 14 else "books" if n >= 7 else "web", r.lang, r.source), []).append(d)
    size = {d: len(words(r.text)) for d, r in rows.items()}
    budgets = mixing.leaf_budgets({p: sum(size[d] for d in ds) for p, ds in leaves.items()}, mixing.WEIGHTS, sum(size.values()) * 8 // 10, 1)
    want = {}
    for path, ds in leaves.items():
        left, whole = budgets[path], budgets[path] == sum(size[d] for d in ds)
        for d in sorted(ds, key=lambda d: hashlib.md5(f"17:0:{d}".encode()).hexdigest()):
            if whole or left > 0:
                want[d] = size[d] if whole else min(left, size[d])
                left -= size[d]
    assert {d: len(words(r.text)) for d, r in after["mixing"].items()} == want
    assert all(rows[d].text.startswith(r.text) for d, r in after["mixing"].items())

    tokenizer, start = Tokenizer.from_file(token_store.tokenizer_path()), 0
    for d, r in sorted(before["token_ids"].items()):
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        got = after["token_ids"][d]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert after["token_ids"].keys() == before["token_ids"].keys()


def test_stages_take_empty_tables_and_nulls(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "x", 0), (None, "a b", "en", "src1", 3), (3, "a b c d e f", None, "", 1), (3, "a b c d e f", None, "", 1)], docs.schema)
    for rows in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            rows = common.materialise(stage(spark, rows, sf_dir), "odd")
        assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
