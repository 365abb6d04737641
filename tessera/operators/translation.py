"""Captured translations put to use: facts translated only where they give no evidence, and whole profiles in another language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR, MOST_CHARS = " | ", 4500


def localize(rows: DataFrame, evidenced: Column, translations: DataFrame, facts: list[str], whole: list[str] | None = None, target: str = "en", source: str = "auto") -> DataFrame:
    """The rows, with their texts translated where ``evidenced`` is not true; adds ``localized``, whether a row was looked at.

    Columns in ``facts`` are facts joined by `` | ``, those in ``whole`` (a summary, say) one text each. Only rows without evidence are cut into
    texts; every different text is looked up once in ``translations`` (text, src, tgt, result) and put back in its place, itself where
    there is no answer, a blank one, or over 4,500 characters. Rows with evidence come through as they are and take part in no join, and
    so do rows that say nothing. Repeated rows stay repeated.
    """
    columns = [(c, True) for c in facts] + [(c, False) for c in whole or []]
    says = F.exists(F.array(*(F.coalesce(c, F.lit("")) for c, _ in columns)), lambda t: t != "")
    marked = rows.withColumn("localized", ~F.coalesce(evidenced, F.lit(False)) & says)
    done, open_ = marked.filter("NOT localized"), marked.filter("localized")
    each = F.array(*(F.struct(F.col(c).alias("whole"), F.lit(cut).alias("cut")) for c, cut in columns))
    texts = open_.select(F.explode(each).alias("f")).select("f.*").filter("whole <> ''").distinct()
    parts = texts.select("whole", "cut", F.posexplode(F.when(F.col("cut"), F.split("whole", r" \| ")).otherwise(F.array("whole"))).alias("n", "text"))
    answers = translations.filter((F.col("tgt") == target) & (F.col("src") == source) & (F.trim("result") != "")).groupBy("text").agg(F.min("result").alias("said"))
    said = F.coalesce(F.when(F.length("text") <= MOST_CHARS, F.trim("said")), "text")
    again = parts.join(answers, "text", "left").groupBy("whole", "cut").agg(F.array_sort(F.collect_list(F.struct("n", said.alias("t")))).alias("p"))
    again = again.select("whole", "cut", F.array_join(F.transform("p", lambda p: p["t"]), SEPARATOR).alias("new"))
    out = open_
    for c, cut in columns:
        new = again.filter(F.col("cut") == cut).select(F.col("whole").alias("_whole"), F.col("new").alias("_new"))
        out = out.join(new, F.col(c) == F.col("_whole"), "left").withColumn(c, F.coalesce("_new", c)).drop("_whole", "_new")
    return done.unionByName(out.select(*done.columns))


def native_profile(parts: DataFrame, native: DataFrame) -> DataFrame:
    """(profile, term, strong, tokens): a profile's terms in another language and which of its tokens each speaks for.

    ``parts`` are (profile, role, term, tokens): role core or qualifier with one token, or phrase with the required tokens of a chunk.
    ``native`` are (term, kept, phrase) as ``lookups.native_terms`` gives them. Words and phrases of core tokens are strong, those
    of qualifiers weak. A chunk that is a phrase there as well speaks as a whole only, its words are weak; a chunk that
    becomes one word is strong. A term found in both ways is strong.
    """
    found = parts.join(native, "term")
    none = F.array().cast("array<string>")
    whole = F.when(F.col("phrase") != "", F.array("phrase")).otherwise(none)
    of = lambda terms, strong, tokens: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(strong).alias("strong"), tokens.alias("tokens")))
    own = F.col("tokens")
    said = (
        F.when(F.col("role") == "core", of(F.concat("kept", whole), True, own))
        .when(F.col("role") == "qualifier", of(F.concat("kept", whole), False, own))
        .when(F.col("phrase") != "", F.concat(of(whole, True, own), of(F.col("kept"), False, none)))
        .when(F.size("kept") == 1, of(F.col("kept"), True, own))
    )
    rows = found.select("profile", F.explode(said).alias("s")).select("profile", "s.term", "s.strong", F.explode_outer("s.tokens").alias("token"))
    return rows.groupBy("profile", "term").agg(F.bool_or("strong").alias("strong"), F.sort_array(F.collect_set("token")).alias("tokens"))


def native_expansion(terms: DataFrame, native: DataFrame) -> DataFrame:
    """(term, native, safe): forms of related terms in another language; of those that are several words there, only the whole is safe evidence."""
    found = terms.select("term").distinct().join(native, "term")
    forms = F.when(F.col("phrase") != "", F.concat(F.transform("kept", lambda t: F.struct(t.alias("native"), F.lit(False).alias("safe"))), F.array(F.struct(F.col("phrase").alias("native"), F.lit(True).alias("safe")))))
    each = found.select("term", F.explode(forms.otherwise(F.transform("kept", lambda t: F.struct(t.alias("native"), F.lit(True).alias("safe"))))).alias("f"))
    return each.groupBy("term", F.col("f.native").alias("native")).agg(F.bool_or("f.safe").alias("safe"))
