"""Five stages that turn raw documents into token ids; each works on all that its predecessor kept.

1. quality: documents that the subword classifier scores below its threshold go.
2. near_duplicates: of every group of linked shingle sets the document with the smallest id stays.
3. decontaminate: documents that hold a benchmark passage go.
4. mixing: a tree of domain, language and source gets four fifths of the tokens that are left, by weight and in one
   seeded epoch; the last document of a source is cut to its first tokens.
5. token_ids: the documents are stored as token ids in directly addressable codes and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontaminate, mixing, ngram_join, quality, token_store

#: SQL cannot express a trained classifier or a tokenizer; the tests hold every stage against a plain version.
ORACLE_SQL: str | None = None
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (8, 10), 1, 17


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model, quality.THRESHOLD)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = mixing.with_domain(docs)
    chosen = mixing.plan(placed, mixing.LEVELS, mixing.WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixing.mix_documents(placed, chosen).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store = token_store.write_store(docs, common.scratch(spark, "pipeline-tokens"), token_store.tokenizer_path())
    return token_store.read_documents(store)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("decontaminate", keep_uncontaminated),
    ("mixing", mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written to the shared scratch folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
