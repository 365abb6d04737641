"""A lexicon of equivalent terms with a user's own clusters, and the gate that keeps geography out of what it suggests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.text import let, stem, strip
from tessera.operators.lookups import runs_of_words, token_words
from tessera.sources.scratch import held

CLUSTER = "cluster_id string, term string"


def clusters_of(raw: Column) -> Column:
    """The clusters in a JSON object of unknown keys, each a key with its list: [[key, term, ...], ...].

    Entries that are no lists, and blank terms, are left out; text that is no JSON object gives none.
    """
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))  # a list arrives as its own text
    listed = F.filter(entries, lambda e: e["value"].startswith("[") & (strip(e["key"]) != ""))
    pairs = F.transform(listed, lambda e: F.struct(e["key"].alias("key"), F.from_json(e["value"], "array<string>").alias("terms")))
    whole = F.transform(pairs, lambda e: F.concat(F.array(e["key"]), F.filter(F.coalesce(e["terms"], F.array().cast("array<string>")), lambda t: strip(F.coalesce(t, F.lit(""))) != "")))
    return F.coalesce(whole, F.array().cast("array<array<string>>"))


def cluster_rows(raw: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (cluster_id, term) of JSON texts, each a user's own clusters."""
    each = raw.select(F.col(key).cast("string").alias("owner"), F.posexplode(clusters_of(F.col(text))).alias("n", "terms"))
    return each.select(F.concat_ws("/", F.lit("user"), "owner", "n").alias("cluster_id"), F.explode("terms").alias("term"))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Rows (cluster_id, term) of JSON files; a missing or broken file gives no rows, so that it never stops a run."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], CLUSTER)
    return cluster_rows(files.select(F.input_file_name().alias("file"), "value"), "file", "value")


def merged(*clusters: DataFrame) -> DataFrame:
    """(cluster_id, term) of all clusters, terms stripped and in lower case, blank ones left out, each once a cluster.

    Every member of a cluster stands for all others, in either direction; clusters that share a term are not merged, but
    that term stands for the members of both. Pairs are made when they are asked for, never for a whole cluster.
    """
    every = clusters[0].select("cluster_id", "term")
    for more in clusters[1:]:
        every = every.unionByName(more.select("cluster_id", "term"))
    return every.withColumn("term", F.lower(strip(F.col("term")))).filter("term <> ''").distinct()


def inner_phrases(low: Column, most: int) -> Column:
    """Everything in a text that could be a term of two to ``most`` words: runs of words whose first may have lost its
    beginning and whose last its end, so that terms meet by equality what holds them anywhere."""

    def run(w: Column, i: Column, n: Column) -> Column:
        first, last = F.get(w, i), F.get(w, i + n - 1)
        middle = F.slice(w, i + 2, n - 2)
        heads = F.transform(F.sequence(F.lit(1), F.length(first)), lambda k: F.substr(first, k))
        tails = F.transform(F.sequence(F.lit(1), F.length(last)), lambda k: F.substr(last, F.lit(1), k))
        return F.flatten(F.transform(heads, lambda h: F.transform(tails, lambda t: F.array_join(F.concat(F.array(h), middle, F.array(t)), " "))))

    def all_runs(w: Column) -> Column:
        ends = lambda i: F.filter(F.sequence(F.lit(2), F.lit(max(most, 2))), lambda n: (i + n <= F.size(w)) & (F.get(w, i) != "") & (F.get(w, i + n - 1) != ""))
        return F.array_distinct(F.flatten(F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.transform(ends(i), lambda n: run(w, i, n))))))

    return let(F.split(low, " "), all_runs)


def held_terms(texts: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """(low, term): the terms (term) of two to ``most`` words that texts (low) hold anywhere.

    Of a term's occurrence the first word ends a word of the text, the last one begins a word, and those between are whole.
    So each distinct word of the texts is cut into its ends and beginnings once, and only those stay that some term has;
    runs of words are made from what is left and meet the terms by equality.
    """
    several = terms.filter(F.size(F.split("term", " ")) > 1)
    firsts = several.select(F.substring_index("term", " ", 1).alias("head")).distinct()
    lasts = several.select(F.substring_index("term", " ", -1).alias("tail")).distinct()
    split = texts.select("low", F.split("low", " ").alias("w"))
    words = split.select(F.explode("w").alias("word")).filter("word <> ''").distinct()
    cut = F.sequence(F.lit(1), F.length("word"))
    heads = words.select("word", F.explode(F.transform(cut, lambda k: F.substr(F.col("word"), k))).alias("head")).hint("merge").join(firsts, "head", "left_semi")
    tails = words.select("word", F.explode(F.transform(cut, lambda k: F.substr(F.col("word"), F.lit(1), k))).alias("tail")).hint("merge").join(lasts, "tail", "left_semi")
    begun = split.select("low", "w", F.posexplode("w").alias("i", "word")).hint("merge").join(heads, "word").drop("word")
    ends = F.filter(F.sequence(F.lit(2), F.lit(max(most, 2))), lambda n: F.col("i") + n <= F.size("w"))
    runs = begun.select("low", "head", "w", "i", F.explode(ends).alias("n"))
    middle = F.slice("w", F.col("i") + 2, F.col("n") - 2)
    runs = runs.select("low", F.array_join(F.concat(F.array("head"), middle), " ").alias("start"), F.get("w", F.col("i") + F.col("n") - 1).alias("word"))
    made = runs.hint("merge").join(tails, "word").select("low", F.concat_ws(" ", "start", "tail").alias("term")).distinct()
    return made.hint("merge").join(several, "term").select("low", "term")


def spoken_for(profiles: DataFrame, lexicon: DataFrame, most_words: int = 5) -> DataFrame:
    """(profile, token, term): what the lexicon (cluster_id, term) suggests for profiles (profile, phrase, tokens array).

    A single word of the lexicon meets the tokens by its stem; one of several words (up to ``most_words``) counts where the phrase holds
    it, and speaks for the tokens with a stem of its own. Without such a token, ``token`` is null: the term stands
    for the phrase as a whole. A term never suggests itself through its own cluster.

    What a word or a phrase is suggested is found once for all profiles that have it. No join is broadcast: each side has several rows for
    a row of its table, which Spark's estimate of its size leaves out.
    """
    words = F.split("term", " ")
    lexicon = held(lexicon, "lexicon")  # read six times
    own = lexicon.select("cluster_id", F.col("term").alias("key"))
    pairs = own.hint("merge").join(lexicon.select("cluster_id", "term"), "cluster_id").filter("term <> key").select("key", "term").distinct()
    keys = lexicon.select("term").distinct()
    tokens = profiles.select("profile", F.explode("tokens").alias("token")).distinct()
    known = tokens.select("token").distinct().withColumn("stem", stem(F.col("token")))
    stemmed = keys.filter(F.size(words) == 1).select(F.col("term").alias("key"), stem(F.col("term")).alias("stem"))
    single = known.hint("merge").join(stemmed, "stem").hint("merge").join(pairs, "key").select("token", "term").distinct()
    by_word = tokens.hint("merge").join(single, "token").select("profile", "token", "term")
    lows = profiles.select("profile", F.lower(F.coalesce("phrase", F.lit(""))).alias("low"))
    inside = held_terms(lows.select("low").distinct(), keys, most_words)
    asked = lows.distinct().hint("merge").join(inside, "low").select("profile", F.col("term").alias("key"))
    stems = asked.distinct().select("profile", "key", F.explode(F.split("key", " ")).alias("w")).select("profile", "key", stem(F.col("w")).alias("stem")).distinct()
    own_stems = tokens.withColumn("stem", stem(F.col("token")))
    several = stems.hint("merge").join(own_stems, ["profile", "stem"], "left").groupBy("profile", "key").agg(F.array_distinct(F.collect_list("token")).alias("t"))
    several = several.select("profile", "key", F.explode_outer("t").alias("token"))
    by_phrase = several.hint("merge").join(pairs, "key").select("profile", "token", "term")
    return by_word.unionByName(by_phrase).distinct()


# Capitals (public facts) of regions whose cities ``lookups.CITIES`` does not name.
CAPITALS = "kabul tirana luanda yerevan baku manama minsk sucre gaborone ouagadougou phnom_penh yaounde havana nicosia quito tallinn addis_ababa libreville conakry tegucigalpa reykjavik tehran baghdad jerusalem yamoussoukro kingston astana bishkek vientiane riga beirut tripoli vilnius antananarivo bamako valletta chisinau ulaanbaatar podgorica maputo naypyidaw windhoek kathmandu wellington managua niamey skopje muscat asuncion kigali dakar belgrade bratislava ljubljana mogadishu pretoria colombo khartoum damascus dodoma lome kampala montevideo tashkent caracas sanaa lusaka harare amman tbilisi zagreb canberra brasilia ottawa washington islamabad abuja hanoi bern buenos_aires"
#: Endings that turn a name into what is said of its people; a final vowel goes before those that begin with one.
ENDINGS, SWALLOWING = ["", "s", "n", "ns"], ["an", "ans", "ian", "ians", "ese", "i", "is", "ish"]


def inflected(token: Column) -> Column:
    """A name with the endings that nouns and adjectives of places take."""
    bare = F.regexp_replace(token, "[aeiouy]+$", "")
    return F.array_distinct(F.concat(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat(token, e)), F.transform(F.array(*map(F.lit, SWALLOWING)), lambda e: F.concat(token, e)), F.transform(F.array(*map(F.lit, SWALLOWING)), lambda e: F.concat(bare, e))))


def geography(places: DataFrame, capitals: str = CAPITALS) -> DataFrame:
    """(run): names, aliases, demonyms and cities as runs of words; the last word of names also inflected."""
    spark = places.sparkSession
    also = spark.createDataFrame([(c.replace("_", " "),) for c in capitals.split()], "token string").withColumn("kind", F.lit(2))
    runs = places.select("token", "kind").unionByName(also).withColumn("w", token_words(F.col("token"))).filter("size(w) > 0")
    plain = runs.select(F.array_join("w", " ").alias("run"))
    start = F.slice("w", 1, F.size("w") - 1)
    formed = runs.filter("kind < 2").select(F.explode(F.transform(inflected(F.element_at("w", -1)), lambda x: F.array_join(F.concat(start, F.array(x)), " "))).alias("run"))
    return plain.union(formed).distinct()


# Words that say nothing of an industry, and function words.
SAY_NOTHING = "service services solution solutions industry industries sector market markets supplier suppliers provider providers firm firms group business businesses company companies best top near online local global international leading quality professional product products the and for with that this are our you your from not their they its all any other such".split()


def good_terms(terms: DataFrame, geo: DataFrame, term: str = "term", anywhere: bool = False) -> DataFrame:
    """Rows whose term may stand for an industry: 1 to 3 words of lower-case letters, not generic, not geography.

    Geography is compared by runs of words: the whole term, or with ``anywhere`` any run inside it. No two tables are compared pair by pair.
    """
    low = F.col(term)
    shape = (F.length(low) >= 3) & (F.size(F.split(strip(low), r"\s+")) <= 3) & low.rlike(r"^[a-z][a-z -]+$") & ~low.isin(fixed.GENERIC_TERMS + SAY_NOTHING)
    runs = runs_of_words(low, 3) if anywhere else F.array(F.array_join(token_words(low), " "))
    kept = terms.filter(shape)
    named = kept.select(low.alias("_term"), F.explode(runs).alias("run")).distinct().join(geo, "run", "left_semi").select("_term").distinct()
    return kept.join(named, low == F.col("_term"), "left_anti")
