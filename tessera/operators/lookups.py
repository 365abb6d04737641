"""Lookups in small dimensions: regions, phone codes, mail servers, synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import contacts, urls
from tessera.functions.text import let, stem, stems, strip
from tessera.operators.ranking import top

# Public facts (ISO 3166 names, country-code domains, ITU calling codes, main languages); ambiguous names are marked.
REGIONS = """
argentina ar +54 es|australia au +61 en|austria at +43 de|bangladesh bd +880 bn|belgium be +32 nl,fr,de|brazil br +55 pt|canada ca +1 en,fr|chile cl +56 es|china cn +86 zh !|denmark dk +45 da|
egypt eg +20 ar|finland fi +358 fi|france fr +33 fr|georgia ge +995 ka !|germany de +49 de|greece gr +30 el|india in +91 hi,en|indonesia id +62 id|ireland ie +353 en|italy it +39 it|
japan jp +81 ja|jordan jo +962 ar !|kenya ke +254 sw,en|mexico mx +52 es|morocco ma +212 ar,fr|netherlands nl +31 nl|nigeria ng +234 en|norway no +47 no|pakistan pk +92 ur|poland pl +48 pl|
portugal pt +351 pt|russia ru +7 ru|spain es +34 es|sweden se +46 sv|switzerland ch +41 de,fr,it|turkey tr +90 tr|united_kingdom uk +44 en|united_states us +1 en|vietnam vn +84 vi|
afghanistan af +93 fa,ps|albania al +355 sq|algeria dz +213 fr,ar|angola ao +244 pt|armenia am +374 hy|azerbaijan az +994 az|bahrain bh +973 ar|belarus by +375 ru|benin bj +229 fr !|bolivia bo +591 es|
botswana bw +267 en|bulgaria bg +359 bg|burkina_faso bf +226 fr|cambodia kh +855 km|cameroon cm +237 fr|chad td +235 fr,ar !|colombia co +57 es|costa_rica cr +506 es|croatia hr +385 hr|cuba cu +53 es|
cyprus cy +357 el|czechia cz +420 cs|dominican_republic do +1809 es|ecuador ec +593 es|el_salvador sv +503 es|estonia ee +372 et|ethiopia et +251 am|gabon ga +241 fr|ghana gh +233 en|guatemala gt +502 es|
guinea gn +224 fr !|honduras hn +504 es|hong_kong hk +852 zh,en|hungary hu +36 hu|iceland is +354 is|iran ir +98 fa|iraq iq +964 ar|israel il +972 he|ivory_coast ci +225 fr|jamaica jm +1876 en|
kazakhstan kz +7 ru,kk|kuwait kw +965 ar|kyrgyzstan kg +996 ru,ky|laos la +856 lo|latvia lv +371 lv|lebanon lb +961 ar|libya ly +218 ar|lithuania lt +370 lt|luxembourg lu +352 fr,de|madagascar mg +261 fr|
malaysia my +60 ms|mali ml +223 fr !|malta mt +356 en|mauritius mu +230 en,fr|moldova md +373 ro|mongolia mn +976 mn|montenegro me +382 sr|mozambique mz +258 pt|myanmar mm +95 my|namibia na +264 en|
nepal np +977 ne|new_zealand nz +64 en|nicaragua ni +505 es|niger ne +227 fr !|north_macedonia mk +389 mk|oman om +968 ar|panama pa +507 es|paraguay py +595 es|peru pe +51 es|philippines ph +63 en|
qatar qa +974 ar|romania ro +40 ro|rwanda rw +250 en,fr|saudi_arabia sa +966 ar|senegal sn +221 fr|serbia rs +381 sr|singapore sg +65 en|slovakia sk +421 sk|slovenia si +386 sl|somalia so +252 so|
south_africa za +27 en|south_korea kr +82 ko|sri_lanka lk +94 si|sudan sd +249 ar|syria sy +963 ar|taiwan tw +886 zh|tanzania tz +255 sw,en|thailand th +66 th|togo tg +228 fr !|tunisia tn +216 fr,ar|
uganda ug +256 en|ukraine ua +380 uk|united_arab_emirates ae +971 ar,en|uruguay uy +598 es|uzbekistan uz +998 uz,ru|venezuela ve +58 es|yemen ye +967 ar|zambia zm +260 en|zimbabwe zw +263 en
"""
ALIASES = "uae=united_arab_emirates,emirates=united_arab_emirates,czech republic=czechia,korea=south_korea,ksa=saudi_arabia,cote d'ivoire=ivory_coast,burma=myanmar,macedonia=north_macedonia,deutschland=germany,españa=spain,italia=italy,polska=poland,maroc=morocco,uk=united_kingdom,great britain=united_kingdom,england=united_kingdom,usa=united_states,us=united_states,america=united_states,holland=netherlands,türkiye=turkey"
DEMONYMS = "moroccan=morocco,egyptian=egypt,polish=poland,swedish=sweden,norwegian=norway,danish=denmark,finnish=finland,greek=greece,portuguese=portugal,brazilian=brazil,mexican=mexico,canadian=canada,australian=australia,austrian=austria,swiss=switzerland,belgian=belgium,irish=ireland,russian=russia,ukrainian=ukraine,romanian=romania,hungarian=hungary,bulgarian=bulgaria,czech=czechia,croatian=croatia,serbian=serbia,chinese=china,korean=south_korea,vietnamese=vietnam,thai=thailand,malaysian=malaysia,indonesian=indonesia,pakistani=pakistan,nigerian=nigeria,kenyan=kenya,ghanaian=ghana,tunisian=tunisia,algerian=algeria,emirati=united_arab_emirates,saudi=saudi_arabia,qatari=qatar,israeli=israel,argentine=argentina,chilean=chile,colombian=colombia,peruvian=peru,german=germany,french=france,spanish=spain,italian=italy,turkish=turkey,british=united_kingdom,american=united_states,dutch=netherlands,japanese=japan,indian=india"
CITIES = "hamburg=germany,vienna=austria,zurich=switzerland,geneva=switzerland,brussels=belgium,antwerp=belgium,copenhagen=denmark,stockholm=sweden,oslo=norway,helsinki=finland,warsaw=poland,prague=czechia,budapest=hungary,bucharest=romania,sofia=bulgaria,athens=greece,lisbon=portugal,barcelona=spain,milan=italy,dublin=ireland,kyiv=ukraine,moscow=russia,ankara=turkey,izmir=turkey,dubai=united_arab_emirates,abu dhabi=united_arab_emirates,riyadh=saudi_arabia,doha=qatar,cairo=egypt,rabat=morocco,tunis=tunisia,algiers=algeria,lagos=nigeria,nairobi=kenya,accra=ghana,johannesburg=south_africa,cape town=south_africa,delhi=india,bangalore=india,karachi=pakistan,bangkok=thailand,jakarta=indonesia,kuala lumpur=malaysia,manila=philippines,seoul=south_korea,shanghai=china,beijing=china,taipei=taiwan,sydney=australia,melbourne=australia,auckland=new_zealand,toronto=canada,montreal=canada,chicago=united_states,san francisco=united_states,sao paulo=brazil,buenos aires=argentina,santiago=chile,bogota=colombia,lima=peru,berlin=germany,munich=germany,paris=france,lyon=france,madrid=spain,rome=italy,istanbul=turkey,london=united_kingdom,new york=united_states,amsterdam=netherlands,tokyo=japan,mumbai=india,dhaka=bangladesh,casablanca=morocco"
# Top-level domains of countries that companies of all countries use.
GENERIC_CC = ["co", "io", "ai", "tv", "me", "fm", "ly", "gg", "to", "cc", "ws", "am", "sh", "ms", "mu", "vc", "la", "is"]


def region_rows() -> list[tuple[str, str, str, list[str], bool]]:
    rows = []
    for part in REGIONS.replace("\n", "").strip().split("|"):
        key, cc, phone, langs, *mark = part.split()
        rows.append((key, cc, phone, langs.split(","), bool(mark)))
    return rows


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(region_rows(), "region_key string, cctld string, phone string, langs array<string>, ambiguous boolean")


def places(spark: SparkSession) -> DataFrame:
    """(token, region_key, kind): 0 names and aliases, 1 demonyms, 2 cities; callers may union their own."""
    pairs = lambda text, kind: [(*p.split("="), kind) for p in text.split(",")]
    rows = [(r[0].replace("_", " "), r[0], 0) for r in region_rows()] + pairs(ALIASES, 0) + pairs(DEMONYMS, 1) + pairs(CITIES, 2)
    return spark.createDataFrame(rows, "token string, region_key string, kind int")


def token_words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def runs_of_words(c: Column, most: int) -> Column:
    """All runs of one to ``most`` words, joined by spaces."""
    return let(token_words(c), lambda w: F.array_distinct(F.flatten(F.transform(w, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(w) - i)), lambda n: F.array_join(F.slice(w, i + 1, n), " "))))))


#: Words of the longest name of a place that is looked for.
LONGEST_PLACE = 6


def resolve_places(df: DataFrame, text: str, key: str, dim: DataFrame, out: str = "region_key", kinds: int = 3, doubtful: list[str] | None = None, longest: int = LONGEST_PLACE) -> DataFrame:
    """Adds the region that the text names: names before demonyms before cities, longer tokens first; null without one.

    Regions in ``doubtful`` (names that mean other things as well) only count where the text names no other.

    A token of up to ``longest`` words is found where it stands as words of its own: the runs of words of a text meet the tokens
    by equality, so the dimension may have any size.
    """
    known = dim.filter(F.col("kind") < kinds).select("token", "kind", F.col("region_key").alias(out), F.array_join(token_words(F.col("token")), " ").alias("_run"))
    texts = df.select(F.col(key).alias("_key"), F.explode(runs_of_words(F.col(text), longest)).alias("_run")).distinct()
    hits = texts.join(known, "_run")
    best = top(hits, ["_key"], [F.col(out).isin(doubtful or []), F.col("kind"), F.length("token").desc(), F.col("token")])
    return df.join(best.select("_key", out), F.col(key) == F.col("_key"), "left").drop("_key")


def phone_country(df: DataFrame, phone: str, key: str, dim: DataFrame, out: str = "phone_region") -> DataFrame:
    """Adds the region of the longest calling code that the number begins with; +1 is the United States and +7 Russia."""
    codes = top(dim.withColumn("_pin", F.when(F.col("region_key").isin("united_states", "russia"), 0).otherwise(1)), ["phone"], [F.col("_pin"), F.col("region_key")])
    bare = F.replace(F.coalesce(F.col(phone), F.lit("")), F.lit(" "), F.lit(""))
    starts = df.select(F.col(key).alias("_key"), F.explode(F.transform(F.sequence(F.lit(2), F.lit(5)), lambda n: F.substr(bare, F.lit(1), n))).alias("phone")).filter("phone like '+%'").distinct()
    found = top(starts.join(codes.select("phone", F.col("region_key").alias(out)), "phone"), ["_key"], [F.length("phone").desc()])
    return df.join(found.select("_key", out), F.col(key) == F.col("_key"), "left").drop("_key")


def region_fit(target: DataFrame) -> DataFrame:
    """Score and reasons of rows (website, phones, address_region, hq_region, region_key, cctld, phone_code, detected_region, ambiguous)."""
    dom = urls.domain(F.col("website"))
    cc = dom.endswith(F.concat(F.lit("."), F.col("cctld")))
    ph = F.contains(F.replace(F.coalesce("phones", F.lit("")), F.lit(" "), F.lit("")), F.col("phone_code"))
    ad = F.coalesce(F.col("address_region") == F.col("region_key"), F.lit(False))
    hq = F.coalesce(F.col("hq_region") == F.col("region_key"), F.lit(False)) & ~ad
    score = F.when(cc, 40).otherwise(0) + F.when(ph, 35).otherwise(0) + F.when(ad, 25).when(hq, 20).otherwise(0)
    other = F.col("detected_region").isNotNull() & (F.col("detected_region") != F.col("region_key")) & ~F.coalesce("ambiguous", F.lit(False))
    conflict = (score == 0) & other
    reasons = F.concat_ws(" | ", F.when(cc, F.concat(F.lit("cctld:."), F.col("cctld"))), F.when(ph, F.concat(F.lit("phone:"), F.col("phone_code"))), F.when(ad, "address_match"), F.when(hq, "hq_match"), F.when(conflict, F.concat(F.lit("conflict:"), F.col("detected_region"))))
    return target.withColumns({"region_fit": F.least(score, F.lit(100)), "region_reasons": reasons, "region_anchor": score > 0, "region_conflict": conflict})


def verify_emails(df: DataFrame, email: str, mx: DataFrame) -> DataFrame:
    """Adds valid and reason: the form first, then the mail server of the domain; unknown domains are given the benefit of the doubt."""
    servers = mx.groupBy(F.lower("domain").alias("_mx")).agg(F.bool_or("has_mx").alias("has_mx"))  # of several answers, one with a server
    problem = contacts.format_problem(F.col(email))
    host = F.lower(contacts.email_host(F.trim(F.col(email))))
    joined = df.join(servers, F.when(problem.isNull(), host) == F.col("_mx"), "left")
    reason = F.coalesce(problem, F.when(F.coalesce("has_mx", F.lit(True)), "ok").otherwise(F.concat(F.lit("no MX record for "), host)))
    return joined.withColumns({"reason": reason, "valid": reason == "ok"}).drop("_mx", "has_mx")


def kept_and_dropped(verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    return verified.filter("valid"), verified.filter("not valid")


def synonym_pairs(clusters: DataFrame) -> DataFrame:
    """(term, synonym): terms of one cluster stand for each other; two clusters that share a term are not merged."""
    other = clusters.select("cluster_id", F.col("term").alias("synonym"))
    return clusters.join(other, "cluster_id").filter("term <> synonym").select("term", "synonym").distinct()


def expand(tokens: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """(token, term, tier): terms of the tiers, an earlier tier winning, without the tokens themselves."""
    all_ = [t.select("token", F.lower("term").alias("term"), F.lit(i).alias("tier")) for i, t in enumerate(tiers)]
    union = all_[0]
    for t in all_[1:]:
        union = union.unionByName(t)
    own = tokens.select(F.col("token").alias("term"))
    good = (F.length("term") >= 3) & (F.size(F.split("term", " ")) <= 3) & F.col("term").rlike(r"^[\p{L} -]+$")
    known = union.join(tokens.select("token"), "token", "left_semi").filter(good).join(own, "term", "left_anti")
    return top(known, ["token", "term"], [F.col("tier")]).select("token", "term", "tier")


def translate(texts: DataFrame, translations: DataFrame, target: str, source: str = "auto") -> DataFrame:
    """(text, result): the captured translation, or the text itself where there is none, it is too long or needs none."""
    found = translations.filter((F.col("tgt") == target) & (F.col("src") == source)).groupBy("text").agg(F.min("result").alias("_result"))
    needs = (F.length("text") <= 4500) & F.lit(bool(target) and target != source)
    return texts.join(found, "text", "left").select("text", F.coalesce(F.when(needs, F.col("_result")), "text").alias("result"))


def native_terms(terms: DataFrame, there: DataFrame, back: DataFrame, function_words: list[str]) -> DataFrame:
    """(term, kept, phrase): what a term is called in another language, from captured answers (text, result) there and back.

    The first of several alternatives counts, if it has at most three words. An answer that leads back to other stems is
    dropped; one without a way back stays. ``kept`` are its words of four letters and more, ``phrase`` is the whole if it has several.
    """
    named = terms.select("term").distinct().join(there.groupBy(F.col("text").alias("term")).agg(F.min("result").alias("said")), "term")
    named = named.filter((F.length("said") > 0) & (F.lower("said") != F.col("term"))).withColumn("said", strip(F.element_at(F.split("said", "[/;|]"), 1)))
    named = named.withColumn("tokens", F.regexp_extract_all(F.lower("said"), F.lit(r"(?U)(\w[\w-]{2,})"), 1)).filter(F.size("tokens").between(1, 3))
    checked = named.join(back.groupBy(F.col("text").alias("said")).agg(F.min("result").alias("again")), "said", "left")
    echo = F.col("again").isNull() | (strip(F.col("again")) == "") | (F.lower(strip(F.col("again"))) == F.lower("said"))
    kept = F.filter("tokens", lambda t: (F.length(t) >= 4) & ~t.isin(function_words))
    rows = checked.filter(echo | F.arrays_overlap(stems(F.col("term")), stems(F.col("again")))).select("term", "tokens", kept.alias("kept"))
    return rows.select("term", "kept", F.when((F.size("tokens") > 1) & (F.size("kept") > 0), F.array_join("tokens", " ")).otherwise("").alias("phrase"))


def language_terms(terms: DataFrame, dim: DataFrame, region_key: str, most: int = 3) -> DataFrame:
    """(term, lang): every term with the first languages in which business is done in a region."""
    langs = dim.select(F.col("region_key").alias("_region"), F.explode(F.slice("langs", 1, most)).alias("lang"))
    asked = terms.select("term").distinct().withColumn("_region", F.lit(region_key))
    return asked.join(langs, "_region").select("term", "lang")


def lexicon_terms(tokens: DataFrame, pairs: DataFrame, phrase: str) -> DataFrame:
    """(token, term): synonyms (term, synonym) that speak for a token of a profile; null token: for the phrase as a whole.

    A single word meets the tokens by its stem, several words count where the phrase holds them.
    """
    words_ = F.split("term", " ")
    keyed = pairs.filter((F.size(words_) == 1) | F.lit(phrase.lower()).contains(F.col("term")))
    parts = keyed.select("term", "synonym", F.size(words_).alias("n"), F.explode(words_).alias("w")).withColumn("stem", stem(F.col("w")))
    spoken = parts.join(tokens.select("token", stem(F.col("token")).alias("stem")), "stem", "left").filter("n > 1 OR token IS NOT NULL")
    return spoken.select("token", F.col("synonym").alias("term")).distinct()


def related_words(datamuse: DataFrame, most: float = 15.0) -> DataFrame:
    """(term, word) of related words that are not too common, the earlier relation and position first; ``place`` orders them."""
    kept = datamuse.filter(F.coalesce("freq", F.lit(0.0)) < most)
    return top(kept, ["term", "word"], [F.col("rel"), F.col("pos")]).select("term", "word", "rel", "pos")
