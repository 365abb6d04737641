"""Related terms of target profiles from all sources together: which count, in what order, and what each speaks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.operators.lexicon import good_terms
from tessera.operators.ranking import top

#: Terms of a profile that are used, and occurrences in a million words from which a related word is everyday language.
MOST_TERMS, EVERYDAY = 24, 15.0
#: Sources, the most trusted first: lexicon, a model, words that mean a token's like, the same of whole phrases, loose associations.
LEXICON, MODEL, LIKE, PHRASE, LOOSE = range(5)
RELATIONS = {"ml": 0, "rel_trg": 1}


def frequency(tags: Column) -> Column:
    """Occurrences in a million words, from the first tag f:... that is a number; 0 without one."""
    numbers = F.transform(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.startswith("f:")), lambda t: F.substring(t, 3, 99).try_cast("double"))
    return F.coalesce(F.get(F.filter(numbers, lambda n: n.isNotNull()), 0), F.lit(0.0))


def related_words(answers: DataFrame, geo: DataFrame, everyday: float = EVERYDAY) -> DataFrame:
    """(term, rel, pos, word) of captured answers (term, rel, raw), JSON lists of words with their tags.

    ``rel`` is ml or rel_trg. Words are kept in the order of the answer if they may stand for an industry and are no everyday language.
    Text that is no JSON list has no words, and what is no object in a list none either; of a word that comes twice in an answer the first counts.
    """
    items = F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>")
    word, tags = (F.try_variant_get("i", f"$.{name}", kind) for name, kind in (("word", "string"), ("tags", "array<string>")))
    rows = answers.filter(F.col("rel").isin(list(RELATIONS))).select(strip(F.col("term")).alias("term"), "rel", F.posexplode(items).alias("pos", "i"))
    rows = rows.filter("term <> ''").select("term", "rel", "pos", F.lower(strip(word)).alias("word"), frequency(tags).alias("freq"))
    kept = good_terms(rows.filter(F.col("freq") < everyday), geo, "word")
    return top(kept, ["term", "rel", "word"], [F.col("pos")]).select("term", "rel", "pos", "word")


def grouped(profiles: DataFrame, spoken: DataFrame, model: DataFrame, related: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(profile, place, term, source, tokens): at most ``most`` related terms of each profile, and the tokens that each is evidence for.

    ``profiles`` are (profile, tokens, chunks): words of the profile, and its phrases of two or three words. ``spoken`` (profile, token, term)
    comes from the lexicon (``lexicon.spoken_for``), ``model`` (profile, term) from a model, ``related`` from ``related_words``.

    Terms of a more trusted source come first, those of the first two by name, the others by token or phrase and in the order of the
    answer; a term counts once, and never a word of the profile. Only the lexicon and words that mean a single token's like speak for tokens.
    """
    own = profiles.select("profile", F.explode("tokens").alias("token")).distinct()
    phrases = profiles.select("profile", F.posexplode("chunks").alias("n", "chunk")).filter(F.size(F.split("chunk", " ")) <= 3)
    rel = F.element_at(F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv)), F.col("rel"))
    row = lambda df, source, term, first, second, third: df.select("profile", F.lower(term).alias("term"), F.lit(source).alias("source"), first.alias("a"), second.cast("int").alias("b"), third.cast("int").alias("c"))
    zero, named = F.lit(0), F.col("term")
    by_token = own.join(related, own["token"] == related["term"]).select("profile", "token", "rel", "pos", "word")
    by_phrase = phrases.join(related, phrases["chunk"] == related["term"]).select("profile", "n", "rel", "pos", "word")
    parts = [
        row(spoken, LEXICON, named, F.lower("term"), zero, zero),
        row(model, MODEL, named, F.lower("term"), zero, zero),
        row(by_token.filter("rel = 'ml'"), LIKE, F.col("word"), F.col("token"), zero, F.col("pos")),
        row(by_phrase, PHRASE, F.col("word"), F.format_string("%05d", "n"), rel, F.col("pos")),
        row(by_token.filter("rel = 'rel_trg'"), LOOSE, F.col("word"), F.col("token"), zero, F.col("pos")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    fresh = every.filter(F.coalesce("term", F.lit("")) != "").join(own.select("profile", F.col("token").alias("term")), ["profile", "term"], "left_anti")
    order = [F.col("source"), F.col("a"), F.col("b"), F.col("c")]
    once = top(fresh, ["profile", "term"], order)
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("profile").orderBy(*order, "term"))).filter(F.col("place") <= most)
    speaks = spoken.filter("token IS NOT NULL").select("profile", F.lower("term").alias("term"), "token").union(by_token.filter("rel = 'ml'").select("profile", F.col("word").alias("term"), "token"))
    tokens = speaks.groupBy("profile", "term").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    out = placed.join(tokens, ["profile", "term"], "left")
    return out.select("profile", "place", "term", "source", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def profile_key(core: Column, others: Column) -> Column:
    """What two ways to write a profile have in common: core words in their order, then the other words by name."""
    rest = F.array_sort(F.array_distinct(F.array_except(others, core)))
    return F.concat(F.array_join(core, " "), F.lit("//"), F.array_join(rest, " "))
