"""Where a company says it is: its address, phone, top-level domain, statements about its seat, a country in its domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed, urls
from tessera.operators import lookups
from tessera.operators.ranking import top

MARKET = "(?:" + "|".join(fixed.MARKET_WORDS) + ")"
#: Group 1 is a market that the statement is about (the place is then no seat), group 2 the place.
IN_PLACE = rf"(\b{MARKET}\W*)?\b(?:{'|'.join(fixed.SEAT_WORDS)})\s+in\s+(\p{{L}}[^\d\n,;:|]{{1,38}})"
PLACE_BASED = rf"(\b{MARKET}\W*[\n,;:|]\W*)?\b(\p{{L}}[^\d\n,;:|]{{0,28}}?)[ -]based\b"


def seat_phrases(c: Column) -> Column:
    """Places of 'based in X', in order, then of 'X-based'.

    As published, X before '-based' may hold up to 29 characters, so it can reach back into the sentence before.
    """
    low = F.lower(F.coalesce(c, F.lit("")))

    def places(pattern: str) -> Column:
        about, place = (F.regexp_extract_all(low, F.lit(pattern), g) for g in (1, 2))
        own = F.filter(F.zip_with(about, place, lambda a, p: F.when(a == "", p)), lambda p: p.isNotNull())
        return own

    return F.concat(places(IN_PLACE), places(PLACE_BASED))


def prose_location(df: DataFrame, text: str, key: str, dim: DataFrame, out: str = "hq_region") -> DataFrame:
    """Adds the region of the first statement about the seat that names a place; null without one."""
    said = df.select(F.col(key).alias("_of"), F.posexplode(seat_phrases(F.col(text))).alias("_at", "_place"))
    said = said.withColumn("_said", F.struct("_of", "_at"))
    named = lookups.resolve_places(said, "_place", "_said", dim, out).filter(F.col(out).isNotNull())
    best = top(named, ["_of"], [F.col("_at")]).select("_of", out)
    return df.join(best, F.col(key) == F.col("_of"), "left").drop("_of")


def domain_country(df: DataFrame, domain: str, key: str, dim: DataFrame, doubtful: list[str], out: str = "domain_region") -> DataFrame:
    """Adds the region whose name, of five letters and more, begins or ends the domain's first label or stands between hyphens.

    Names meet the label's beginnings, ends and parts by equality; the longest wins.
    """
    label = F.lower(urls.first_label(F.coalesce(F.col(domain), F.lit(""))))
    cuts = lambda part: F.when(F.length(label) >= 5, F.transform(F.sequence(F.lit(5), F.greatest(F.length(label), F.lit(5))), part)).otherwise(F.array().cast("array<string>"))
    runs = F.array_distinct(F.concat(cuts(lambda n: F.left(label, n)), cuts(lambda n: F.right(label, n)), F.split(label, r"[^\p{L}]+")))
    bare = F.replace(F.col("token"), F.lit(" "), F.lit(""))
    names = dim.filter((F.col("kind") == 0) & ~F.col("region_key").isin(doubtful)).select(bare.alias("_run"), F.col("region_key").alias(out)).filter("length(_run) >= 5")
    hits = df.select(F.col(key).alias("_of"), F.explode(runs).alias("_run")).join(names, "_run")
    best = top(hits, ["_of"], [F.length("_run").desc(), F.col("_run"), F.col(out)]).select("_of", out)
    return df.join(best, F.col(key) == F.col("_of"), "left").drop("_of")


def tld_country(df: DataFrame, domain: str, dim: DataFrame, out: str = "tld_region") -> DataFrame:
    """Adds the region of the top-level domain, unless companies everywhere use it."""
    codes = dim.filter(~F.col("cctld").isin(lookups.GENERIC_CC)).groupBy(F.col("cctld").alias("_cc")).agg(F.min("region_key").alias(out))
    return df.join(codes, F.when(F.contains(F.col(domain), F.lit(".")), F.substring_index(domain, ".", -1)) == F.col("_cc"), "left").drop("_cc")


#: Ways of saying where a company is, the surest first.
ADDRESS, PHONE, TLD, SEAT, DOMAIN = range(5)


def said_places(domain: Column, longest: int) -> Column:
    """array<struct<way, at, run>>: all that (address, phones, website, summary) say which may name a region."""
    runs = lambda way, at, items: F.transform(items, lambda x: F.struct(F.lit(way).alias("way"), at.alias("at"), x.alias("run")))
    label = F.lower(urls.first_label(domain))
    cuts = lambda part: F.when(F.length(label) >= 5, F.transform(F.sequence(F.lit(5), F.greatest(F.length(label), F.lit(5))), part)).otherwise(F.array().cast("array<string>"))
    bare = F.replace(F.coalesce("phones", F.lit("")), F.lit(" "), F.lit(""))
    starts = F.when(bare.startswith("+"), F.transform(F.sequence(F.lit(2), F.lit(5)), lambda n: F.left(bare, n))).otherwise(F.array().cast("array<string>"))
    seats = F.flatten(F.transform(seat_phrases(F.col("summary")), lambda p, i: runs(SEAT, i, lookups.runs_of_words(p, longest))))
    return F.concat(
        runs(ADDRESS, F.lit(0), lookups.runs_of_words(F.col("address"), longest)),
        runs(PHONE, F.lit(0), starts),
        runs(TLD, F.lit(0), F.array(F.when(F.contains(domain, F.lit(".")), F.substring_index(domain, ".", -1)).otherwise(""))),
        seats,
        runs(DOMAIN, F.lit(0), F.array_distinct(F.concat(cuts(lambda n: F.left(label, n)), cuts(lambda n: F.right(label, n)), F.split(label, r"[^\p{L}]+")))),
    )


def known_places(places: DataFrame, regions: DataFrame) -> DataFrame:
    """(way, run, region, rank): what each way of saying it may meet, lower ranks first."""
    rank = lambda a=0, b=0, c=0, d="": F.struct(*((x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in zip("abcd", (a, b, c, d), strict=True)))
    marked = places.join(regions.groupBy("region_key").agg(F.bool_or("ambiguous").alias("doubtful")), "region_key", "left")
    doubtful, token = F.coalesce("doubtful", F.lit(False)), F.col("token")
    named = marked.select("kind", "token", "region_key", doubtful.cast("int").alias("doubtful"), F.array_join(lookups.token_words(token), " ").alias("run"), F.replace(token, F.lit(" "), F.lit("")).alias("bare"))
    of = lambda df, way, run, r: df.select(F.lit(way).alias("way"), run.alias("run"), F.col("region_key").alias("region"), r.alias("rank"))
    length = lambda c: -F.length(c)
    pinned = F.when(F.col("region_key").isin("united_states", "russia"), 0).otherwise(1)
    parts = [
        of(named.filter("kind < 2"), ADDRESS, F.col("run"), rank(F.col("doubtful"), F.col("kind"), length("token"), token)),
        of(regions, PHONE, F.col("phone"), rank(length("phone"), pinned)),
        of(regions.filter(~F.col("cctld").isin(lookups.GENERIC_CC)), TLD, F.col("cctld"), rank()),
        of(named, SEAT, F.col("run"), rank(0, F.col("kind"), length("token"), token)),
        of(named.filter("kind = 0 AND doubtful = 0 AND length(bare) >= 5"), DOMAIN, F.col("bare"), rank(length("bare"), 0, 0, F.col("bare"))),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def detected_country(df: DataFrame, key: str, places: DataFrame, regions: DataFrame, out: str = "country", longest: int = lookups.LONGEST_PLACE) -> DataFrame:
    """Adds the best guess from (address, phones, website, summary): address, phone code, top-level domain, seat, domain; empty if unknown.

    All that a row says is exploded at once and meets all known places in one join; the best hit of each key goes back to its rows.
    ``longest`` is the number of words of the longest name. A null key finds nothing.
    """
    said = df.select(F.col(key).alias("_of"), F.explode(said_places(urls.domain(F.coalesce("website", F.lit(""))), longest)).alias("s")).select("_of", "s.*")
    hits = said.filter("_of IS NOT NULL").join(known_places(places, regions), ["way", "run"])
    best = hits.groupBy("_of").agg(F.min_by("region", F.struct("way", "at", "rank", "region")).alias("_best"))
    return df.join(best, F.col(key) == F.col("_of"), "left").withColumn(out, F.coalesce("_best", F.lit(""))).drop("_of", "_best")


def same_region(df: DataFrame, region: str, country: str, key: str, dim: DataFrame, out: str = "country_matches", longest: int = lookups.LONGEST_PLACE) -> DataFrame:
    """Adds whether two texts name the same region; false where either names none."""
    texts = F.flatten(F.transform(F.array(F.struct(F.lit(0).alias("n"), F.col(region).alias("t")), F.struct(F.lit(1).alias("n"), F.col(country).alias("t"))), lambda x: F.transform(lookups.runs_of_words(x["t"], longest), lambda r: F.struct(x["n"].alias("n"), r.alias("run")))))
    known = dim.filter("kind < 1").select(F.array_join(lookups.token_words(F.col("token")), " ").alias("run"), "region_key", "token")
    hits = df.select(F.col(key).alias("_of"), F.explode(texts).alias("s")).select("_of", "s.*").join(known, "run")
    rank = F.struct(-F.length("token"), "token", "region_key")
    found = lambda n: F.min_by(F.when(F.col("n") == n, F.col("region_key")), F.when(F.col("n") == n, rank))
    both = hits.groupBy("_of").agg((found(0) == found(1)).alias("_same"))
    return df.join(both, F.col(key) == F.col("_of"), "left").withColumn(out, F.coalesce("_same", F.lit(False))).drop("_of", "_same")
