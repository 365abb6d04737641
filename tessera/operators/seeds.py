"""Companies that a model knows for a profile and a region: what it is asked, and its captured answers as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.operators.ranking import top

#: Related terms in a prompt, companies asked for, and local indexes that are followed.
RELATED, COMPANIES, DIRECTORIES = 8, 30, 10


def prompts(profiles: DataFrame, related: DataFrame, count: int = COMPANIES) -> DataFrame:
    """(profile, prompt) for profiles (profile, phrase, region); the first related terms (profile, term) by name are in scope as well."""
    terms = related.filter(strip(F.col("term")) != "").select("profile", "term").distinct()
    few = top(terms, ["profile"], [F.col("term")], RELATED).groupBy("profile").agg(F.array_join(F.array_sort(F.collect_list("term")), ", ").alias("_terms"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    text = F.concat_ws(
        "\n",
        line("Industry wanted", strip(F.col("phrase"))),
        line("Country or region", strip(F.col("region"))),
        line("Words for the same industry", F.col("_terms")),
        F.lit(f"Name up to {count} companies of that industry that do business there today, small and local ones first."),
        F.lit("Name regulators, associations and chambers of that country that keep lists of such companies."),
        F.lit('Answer with one JSON object: {"companies": [names], "local_directories": [names or addresses]}'),
    )
    return profiles.join(few, "profile", "left").select("profile", text.alias("prompt"))


def texts_in(answer: Column, field: str) -> Column:
    """The strings of a list in a JSON object, stripped; whatever is no string, or blank, is left out."""
    items = F.try_variant_get(answer, f"$.{field}", "array<variant>")
    said = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", strip(F.try_variant_get(v, "$", "string"))))
    return F.coalesce(F.filter(said, lambda s: s.isNotNull() & (s != "")), F.array().cast("array<string>"))


def seeds(answers: DataFrame, most: int = COMPANIES, directories: int = DIRECTORIES) -> DataFrame:
    """(profile, kind, pos, name) of answers (profile, raw): companies, each once whatever its case, and local directories.

    Talk and fences around the JSON object are ignored; an answer without one gives nothing. Of several answers of a profile the
    first by its text counts.
    """
    bare = F.regexp_extract(F.regexp_replace("raw", "```(?:json)?", ""), r"(?s)\{.*\}", 0)
    read = answers.groupBy("profile").agg(F.min("raw").alias("raw")).select("profile", F.try_parse_json(F.nullif(bare, F.lit(""))).alias("a"))
    both = read.select("profile", texts_in(F.col("a"), "companies").alias("company"), texts_in(F.col("a"), "local_directories").alias("directory"))
    once = lambda names: F.filter(names, lambda n, i: ~F.array_contains(F.slice(F.transform(names, F.lower), 1, i), F.lower(n)))
    of = lambda kind, names, n: both.select("profile", F.lit(kind).alias("kind"), F.posexplode(F.slice(names, 1, n)).alias("pos", "name"))
    return of("company", once(F.col("company")), most).union(of("directory", F.col("directory"), directories))


def directory_queries(found: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, pos, query): a search for each local directory in the profile's region."""
    return found.filter("kind = 'directory'").join(profiles.select("profile", "region"), "profile").select("profile", "pos", F.concat_ws(" ", "name", strip(F.col("region"))).alias("query"))
