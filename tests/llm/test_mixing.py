import hashlib
import random

import pytest

from tessera.llm import mixing as M


def test_allocate_shares_shortages():
    assert M.allocate(100, {"a": (1000, 1), "b": (1000, 3)}) == {"a": 25, "b": 75}
    assert M.allocate(100, {"a": (10, 1), "b": (1000, 1), "c": (1000, 2)}) == {"a": 10, "b": 30, "c": 60}
    assert M.allocate(100, {"a": (10, 1), "b": (20, 5)}) == {"a": 10, "b": 20}
    assert M.allocate(100, {"a": (500, 0), "b": (20, 5)}) == {"a": 0, "b": 20}
    assert sum(M.allocate(101, {c: (1000, 1) for c in "abcdefg"}).values()) == 101


def test_shortage_stays_below_its_ancestor():
    leaves = {("w", "en", "1"): 10, ("w", "en", "2"): 1000, ("w", "de", "3"): 1000, ("b", "en", "4"): 1000}
    got = M.leaf_budgets(leaves, {("w",): 1, ("b",): 1}, 400, 1)
    assert got == {("w", "en", "1"): 10, ("w", "en", "2"): 90, ("w", "de", "3"): 100, ("b", "en", "4"): 200}
    got = M.leaf_budgets(leaves | {("w", "de", "3"): 30}, {}, 400, 2)
    assert got == {("w", "en", "1"): 20, ("w", "en", "2"): 120, ("w", "de", "3"): 60, ("b", "en", "4"): 200}


def brute(rows, budgets, seed):
    out = []
    for path, budget in budgets.items():
        mine = [r for r in rows if r[1:3] == path]
        total, epoch = sum(r[3] for r in mine), 0
        while budget > 0 and total:
            if budget >= total:
                out += [(r[0], epoch, r[3]) for r in mine]
                budget -= total
            else:
                for r in sorted(mine, key=lambda r: hashlib.md5(f"{seed}:{epoch}:{r[0]}".encode()).hexdigest()):
                    if budget <= 0:
                        break
                    out.append((r[0], epoch, min(budget, r[3])))
                    budget -= r[3]
                budget = 0
            epoch += 1
    return sorted(out)


@pytest.mark.parametrize("share, epochs", [((1, 3), 1), ((9, 10), 3), ((5, 1), 2), ((0, 1), 2)])
def test_plan_equals_brute_force(spark, share, epochs):
    rng = random.Random(share[0])
    rows = [(i, rng.choice("aaab"), rng.choice("xyyyyyyyz"), rng.randrange(0, 50)) for i in range(600)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, p string, q string, n long, epoch string")
    weights = {("a",): 1, ("b",): 4, ("b", "z"): 0}
    plan = M.plan(df, ["p", "q"], weights, share, epochs, 5, tokens=M.F.col("n"))
    held = {}
    for r in rows:
        held[r[1:3]] = held.get(r[1:3], 0) + r[3]
    budgets = M.leaf_budgets(held, weights, sum(held.values()) * share[0] // share[1], epochs)
    got = sorted((r.doc_id, r.e, r.k) for r in plan.select(df, "doc_id", M.F.col("n"), ("e", "k")).collect())
    assert got == brute(rows, budgets, 5)


def test_documents_are_cut_to_tokens_and_edge_rows(spark):
    rows = [(1, "a  b\tc\n d", "en"), (2, None, "en"), (3, "", None), (4, "x y z", None), (4, "x y z", None), (None, "q", "en")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, `mix epoch` int")
    everything = M.mix_documents(df, M.plan(df, ["lang"], {}, (1, 1), 1))
    assert everything.columns == df.columns and sorted(everything.collect(), key=repr) == sorted(df.collect(), key=repr)
    one = df.filter("doc_id = 1")
    assert [r.text for r in M.mix_documents(one, M.plan(one, ["lang"], {}, (3, 4), 1)).collect()] == ["a  b\tc"]
    assert M.mix_documents(df.limit(0), M.plan(df.limit(0), ["lang"], {}, (1, 1), 1)).count() == 0
