"""Mixing sources to target weights by hierarchical token budgets.

The tree has one level for each of the given columns (domain, language, source in the query). A budget goes down from the
root: a node gives its children shares in proportion to their weights; a child that holds less than its share gets all it has
and the shortage goes to its siblings, again by weight, until no child is short. What a whole subtree lacks is thus shared
among the subtree's siblings before anything reaches other branches. A child holds its tokens times ``max_epochs``.

Each leaf reads its documents in seeded epochs: epoch e orders them by md5(seed:e:id). The leaf takes whole epochs
while its budget lasts, then a prefix of the next epoch, of which the last document may be cut to its first tokens. Tokens are
runs of characters other than space, tab, newline, vertical tab, form feed and carriage return.

Only figures by leaf pass through the driver (at most ``MOST_LEAVES`` of them, else an error). The cut of a leaf is found from
the sums of 4,096 hash ranges and then the rows of one range, so a leaf with a third of all documents is no bottleneck.

Defined cases: a null level counts as the empty string; a null or empty text has no tokens and is taken while its place is
before the cut; leaves or children without a weight in ``weights`` get weight 1, weight 0 gets nothing; rows of one id share a
place, and at the cut get the same prefix each; a budget beyond all capacity takes everything; an empty table, or a budget of
0, gives no rows; columns of the input that share a name with a figure stay as they are in ``select``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

TOKEN = r"[^\x09-\x0D ]+"
MOST_LEAVES = 100_000


def allocate(budget: int, children: dict[str, tuple[int, int]]) -> dict[str, int]:
    """Whole tokens for each child, given as name -> (capacity, weight)."""
    given = {name: 0 for name in children}
    open_ = sorted((name for name, (_, w) in children.items() if w > 0), key=lambda n: (children[n][0] / children[n][1], n))
    weight = sum(children[n][1] for n in open_)
    budget = min(budget, sum(children[n][0] for n in open_))
    while open_ and children[open_[0]][0] * weight <= children[open_[0]][1] * budget:
        name = open_.pop(0)
        given[name] = children[name][0]
        budget, weight = budget - children[name][0], weight - children[name][1]
    for name in open_:
        given[name] = children[name][1] * budget // weight
    for name in sorted(open_)[: budget - sum(given[n] for n in open_)]:
        given[name] += 1
    return given


def leaf_budgets(leaves: dict[tuple[str, ...], int], weights: dict[tuple[str, ...], int], budget: int, max_epochs: int) -> dict[tuple[str, ...], int]:
    """Budgets of the leaves (path -> tokens held); weights are by path from the root, 1 where none is given."""
    out: dict[tuple[str, ...], int] = {}

    def down(prefix: tuple[str, ...], part: dict[tuple[str, ...], int], share: int) -> None:
        if part.keys() == {prefix}:
            out[prefix] = share
            return
        below: dict[str, dict] = {}
        for path, n in part.items():
            below.setdefault(path[len(prefix)], {})[path] = n
        # a subtree holds what its leaves of positive weight hold
        given = allocate(share, {name: (held(prefix + (name,), sub), weights.get(prefix + (name,), 1)) for name, sub in below.items()})
        for name, sub in below.items():
            down(prefix + (name,), sub, given[name])

    def held(prefix: tuple[str, ...], part: dict[tuple[str, ...], int]) -> int:
        return sum(n * max_epochs for path, n in part.items() if all(weights.get(path[:k], 1) for k in range(len(prefix) + 1, len(path) + 1)))

    if leaves:
        down((), leaves, budget)
    return out


class Plan:
    """What each leaf takes: whole epochs, and the place and length of the cut in the next one."""

    def __init__(self, levels: list[str], seed: int, leaves: DataFrame):
        self.levels, self.seed, self.leaves = levels, seed, leaves

    def place(self, id_col: str, epoch: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(self.seed).cast("string"), epoch.cast("string"), F.col(id_col).cast("string")))

    def select(self, docs: DataFrame, id_col: str, tokens: Column, out: tuple[str, str] = ("epoch", "take_tokens")) -> DataFrame:
        """The rows of ``docs`` that are taken, once an epoch, with the epoch and how many of their tokens."""
        p = common.free_name(docs, "mix")  # the figures travel under names that the table does not have
        leaves = F.broadcast(self.leaves.select(*(F.col(c).alias(f"{p} level {c}") for c in self.levels), *(F.col(c).alias(f"{p} {c}") for c in ("full", "cut", "cut_tokens"))))
        same = [F.coalesce(docs[c].cast("string"), F.lit("")) == leaves[f"{p} level {c}"] for c in self.levels]
        full, n = F.col(f"{p} full"), F.col(f"{p} n")
        joined = docs.join(leaves, same).withColumn(f"{p} n", tokens)
        place = self.place(id_col, full)
        part = F.when(place < F.col(f"{p} cut"), n).when(place == F.col(f"{p} cut"), F.least(n, F.col(f"{p} cut_tokens")))
        none = F.array().cast("array<struct<e: int, n: bigint>>")
        whole = F.when(full > 0, F.transform(F.sequence(F.lit(0), full - 1), lambda e: F.struct(e.cast("int").alias("e"), n.alias("n")))).otherwise(none)
        last = F.when(part.isNotNull(), F.array(F.struct(full.cast("int").alias("e"), part.cast("bigint").alias("n")))).otherwise(none)
        rows = joined.select(*(docs[c] for c in docs.columns), F.explode(F.concat(whole, last)).alias(f"{p} take"))
        return rows.select(*(rows[c] for c in docs.columns), F.col(f"`{p} take`.e").alias(out[0]), F.col(f"`{p} take`.n").alias(out[1]))


def token_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN)).cast("bigint")


def plan(docs: DataFrame, levels: list[str], weights: dict[tuple[str, ...], int], share: tuple[int, int], max_epochs: int = 2, seed: int = 1, id_col: str = "doc_id", tokens: Column | None = None) -> Plan:
    """Budget: ``share`` (numerator, denominator) of all tokens of ``docs``."""
    spark = docs.sparkSession
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]
    light = docs.select(F.col(id_col).alias("id"), *named, (tokens if tokens is not None else token_count("text")).alias("n"))
    light = common.materialise(light, "mix-figures")
    sums = light.groupBy(*levels).agg(F.sum("n").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(sums) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    held = {tuple(r[c] for c in levels): r.n for r in sums}
    budgets = leaf_budgets(held, weights, sum(held.values()) * share[0] // share[1], max_epochs)
    rows = [(*path, *divmod(b, held[path])) if held[path] else (*path, 0, 0) for path, b in budgets.items()]
    fields = ", ".join(f"`{c}` string" for c in levels)
    leaves = spark.createDataFrame(rows, f"{fields}, full bigint, rest bigint")
    asked = F.broadcast(leaves.filter("rest > 0"))  # at most MOST_LEAVES rows
    found = Plan(levels, seed, leaves)
    placed = light.join(asked, levels).withColumn("place", found.place("id", F.col("full"))).withColumn("bucket", F.substring("place", 1, 3))
    before = lambda *by: Window.partitionBy(*by)
    ranges = placed.groupBy(*levels, "bucket").agg(F.sum("n").alias("sum"), F.first("rest").alias("rest"))
    ranges = ranges.withColumn("upto", F.sum("sum").over(before(*levels).orderBy("bucket")))
    at = ranges.filter("upto >= rest and upto - sum < rest").select(*levels, "bucket", (F.col("upto") - F.col("sum")).alias("base"))
    inside = placed.join(F.broadcast(at), [*levels, "bucket"]).groupBy(*levels, "bucket", "place").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    inside = inside.withColumn("upto", F.col("base") + F.sum("n").over(before(*levels, "bucket").orderBy("place")))
    cuts = inside.filter("upto >= rest and upto - n < rest").select(*levels, F.col("place").alias("cut"), (F.col("rest") - F.col("upto") + F.col("n")).alias("cut_tokens")).collect()
    cut = {tuple(r[c] for c in levels): (r.cut, r.cut_tokens) for r in cuts}
    found.leaves = spark.createDataFrame([(*r[:-1], *cut.get(r[: len(levels)], ("", 0))) for r in rows], f"{fields}, full bigint, cut string, cut_tokens bigint")
    return found


def mix_documents(docs: DataFrame, chosen: Plan, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The taken rows with the columns of ``docs``; the text of a cut document ends with its last taken token."""
    tokens = tokens if tokens is not None else token_count(text_col)
    n = f"{common.free_name(docs, 'taken')} tokens"
    taken = chosen.select(docs, id_col, tokens, (f"{n} epoch", n))
    words = F.regexp_extract_all(F.col(text_col), F.lit(rf"([\x09-\x0D ]*{TOKEN})"), 1)
    text = F.when(F.col(n) < token_count(text_col), F.array_join(F.slice(words, 1, F.col(n).cast("int")), "")).otherwise(F.col(text_col))
    return taken.withColumn(text_col, text).select(*docs.columns)


# --- the query: a tree of domain, language and source ------------------------------------------------------------

LEVELS = ["domain", "lang", "source"]
DOMAINS = {"web": 5, "books": 3, "code": 2}
LANGUAGES = {"en": 4, "de": 2, "fr": 2, "es": 4}
WEIGHTS = {(d,): w for d, w in DOMAINS.items()} | {(d, lang): w for d in DOMAINS for lang, w in LANGUAGES.items()}
SHARE, MAX_EPOCHS, SEED = (6, 10), 2, 17


def with_domain(docs: DataFrame) -> DataFrame:
    """A made-up domain by the number in the source's name: web up to 6, books up to 13, code beyond; web without one."""
    number = F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)', 1) as int)")
    return docs.withColumn("domain", F.when(number >= 14, "code").when(number >= 7, "books").otherwise("web"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    light = common.materialise(docs.select("doc_id", *LEVELS, token_count("text").alias("n_tokens")), "mix-input")
    chosen = plan(light, LEVELS, WEIGHTS, SHARE, MAX_EPOCHS, SEED, tokens=F.col("n_tokens"))
    return chosen.select(light, "doc_id", F.col("n_tokens"))


def _level(k: int, parent: str) -> str:
    """SQL that gives the budgets of level k's nodes from those of their parents, as ``allocate`` does."""
    up, own = ", ".join(LEVELS[:k]), ", ".join(LEVELS[: k + 1])
    by = f"PARTITION BY {up}" if k else ""
    on = f"JOIN {parent} p USING ({up})" if k else f"CROSS JOIN {parent} p"
    weight = {
        0: "CASE domain " + " ".join(f"WHEN '{d}' THEN {w}" for d, w in DOMAINS.items()) + " ELSE 1 END",
        1: "CASE lang " + " ".join(f"WHEN '{d}' THEN {w}" for d, w in LANGUAGES.items()) + " ELSE 1 END",
        2: "1",
    }[k]
    return f"""
c{k} AS (SELECT {own}, cap, w, least(budget, sum(cap) OVER ({by})) AS b
         FROM (SELECT {own}, sum(n)::HUGEINT * {MAX_EPOCHS} AS cap, ({weight})::HUGEINT AS w FROM leaves GROUP BY {own}) s {on}),
r{k} AS (SELECT *, b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS brem,
                sum(w) OVER ({by}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wrem
         FROM c{k} WINDOW o AS ({by} ORDER BY cap::DOUBLE / w::DOUBLE, {LEVELS[k]})),
s{k} AS (SELECT *, cap * wrem <= w * brem AS sat FROM r{k}),
t{k} AS (SELECT *, b - coalesce(sum(cap) FILTER (sat) OVER ({by}), 0) AS bs, sum(w) FILTER (NOT sat) OVER ({by}) AS ws FROM s{k}),
u{k} AS (SELECT *, CASE WHEN sat THEN cap ELSE w * bs // ws END AS g FROM t{k}),
b{k} AS (SELECT {own}, g + CASE WHEN NOT sat AND row_number() OVER (PARTITION BY {up + ', ' if k else ''}sat ORDER BY {LEVELS[k]}) <= bs - sum(g) FILTER (NOT sat) OVER ({by}) THEN 1 ELSE 0 END AS budget FROM u{k})"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)', 1) AS INTEGER) AS num,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D ]+'))::BIGINT AS n_tokens FROM documents),
docs AS (SELECT doc_id, CASE WHEN num >= 14 THEN 'code' WHEN num >= 7 THEN 'books' ELSE 'web' END AS domain, lang, source, n_tokens FROM d),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS n FROM docs GROUP BY ALL),
root AS (SELECT sum(n)::HUGEINT * {SHARE[0]} // {SHARE[1]} AS budget FROM leaves),
{_level(0, 'root')},{_level(1, 'b0')},{_level(2, 'b1')},
l AS (SELECT domain, lang, source, CASE WHEN n > 0 THEN (budget // n)::BIGINT ELSE 0 END AS f, CASE WHEN n > 0 THEN (budget % n)::BIGINT ELSE 0 END AS rest FROM b2 JOIN leaves USING (domain, lang, source)),
p AS (SELECT docs.*, f, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{SEED}:', f, ':', doc_id)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM docs JOIN l USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, e::INTEGER AS epoch, n_tokens AS take_tokens FROM (SELECT *, unnest(range(0, f)) AS e FROM p)
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, f::INTEGER, least(n_tokens, rest - before)::BIGINT FROM p WHERE before < rest
"""
