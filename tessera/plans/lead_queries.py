"""Queries of discovery over the driver's tables: locations, verdicts, prompts, search, expansion. Each with SQL that computes the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed, icp, prompts, urls
from tessera.operators import judging, locations, lookups, search
from tessera.plans import engine
from tessera.plans.catalogue import HOST, PLACES, REGION_VALUES, inside, literal, query, sql_domain, strings, table

# --- where companies are ---------------------------------------------------------------------------------------------

#: Each customer gets a country and one of ten ways to say it.
COUNTRIES = [(r[0], r[0].replace("_", " "), r[1], r[2]) for r in lookups.region_rows()]
DOUBTFUL = [r[0] for r in lookups.region_rows() if r[4]]
PLACE_VALUES = literal(PLACES, "token, region_key, kind")
SAID_SQL = f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY region_key) - 1 AS n FROM {literal(COUNTRIES, "region_key, name, cc, phone")}),
said AS (SELECT c_custkey AS id, c_custkey % 10 AS way, name, cc, phone FROM customer JOIN numbered ON (c_custkey * 7) % {len(COUNTRIES)} = n),
companies AS (SELECT id, CASE WHEN way = 0 THEN '12 Main St, ' || name WHEN way = 1 THEN 'Atlanta, Georgia, ' || name END AS address,
  CASE WHEN way = 2 THEN phone || ' 5 55' WHEN way = 3 THEN '030 1' END AS phones,
  CASE WHEN way = 4 THEN 'https://www.a' || id || '.' || cc WHEN way = 5 THEN 'https://acme-' || replace(name, ' ', '') || '.com/x' WHEN way = 9 THEN NULL ELSE 'https://a' || id || '.com' END AS website,
  CASE WHEN way = 6 THEN 'We make things. Headquartered in ' || upper(name) || ', we grow.' WHEN way = 7 THEN 'We serve customers based in ' || name || ', and more' WHEN way = 8 THEN 'A ' || name || '-based firm, registered in Nowhere, sold' ELSE '' END AS summary FROM said)"""


def companies(spark, sf_dir):
    rows = [(*c, n) for n, c in enumerate(sorted(COUNTRIES))]
    numbered = spark.createDataFrame(rows, "region_key string, name string, cc string, phone string, n int")
    said = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10).alias("way"), ((F.col("c_custkey") * 7) % len(rows)).cast("int").alias("n")).join(F.broadcast(numbered), "n")
    return said.selectExpr(
        "id", "CASE WHEN way = 0 THEN '12 Main St, ' || name WHEN way = 1 THEN 'Atlanta, Georgia, ' || name END AS address",
        "CASE WHEN way = 2 THEN phone || ' 5 55' WHEN way = 3 THEN '030 1' END AS phones",
        "CASE WHEN way = 4 THEN 'https://www.a' || id || '.' || cc WHEN way = 5 THEN 'https://acme-' || replace(name, ' ', '') || '.com/x' WHEN way = 9 THEN NULL ELSE 'https://a' || id || '.com' END AS website",
        "CASE WHEN way = 6 THEN 'We make things. Headquartered in ' || upper(name) || ', we grow.' WHEN way = 7 THEN 'We serve customers based in ' || name || ', and more' WHEN way = 8 THEN 'A ' || name || '-based firm, registered in Nowhere, sold' ELSE '' END AS summary",
    )


def sql_raw(pattern: str) -> str:
    return pattern.replace("'", "''")


def sql_spans(pattern: str, kind: int) -> str:
    pairs = f"list_zip(regexp_extract_all(low, '{sql_raw(pattern)}', 1), regexp_extract_all(low, '{sql_raw(pattern)}', 2))"
    return f"SELECT id, {kind} AS kind, generate_subscripts({pairs}, 1) AS pos, unnest({pairs}) AS p FROM (SELECT id, lower(coalesce(summary, '')) AS low FROM companies)"


def norm(c: str) -> str:
    return f"' ' || trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


SEAT_SQL = f"""
spans AS ({sql_spans(locations.IN_PLACE, 0)} UNION ALL {sql_spans(locations.PLACE_BASED, 1)}),
places AS (SELECT token, region_key, kind AS rank, {norm('token')} AS word FROM {PLACE_VALUES}),
seats AS (SELECT id, region_key FROM (SELECT s.id, region_key, row_number() OVER (PARTITION BY s.id ORDER BY s.kind, s.pos, rank, length(token) DESC, token) AS n
  FROM spans s JOIN places ON contains({norm('s.p[2]')}, word) WHERE coalesce(s.p[1], '') = '') WHERE n = 1)"""


@query(f"WITH {SAID_SQL}, {SEAT_SQL} SELECT id, summary, region_key AS hq_region FROM companies LEFT JOIN seats USING (id)")
def prose_location(spark, sf_dir):
    return locations.prose_location(companies(spark, sf_dir), "summary", "id", lookups.places(spark)).select("id", "summary", "hq_region")


@query(f"""
WITH {SAID_SQL}, {SEAT_SQL},
d AS (SELECT *, {sql_domain("regexp_extract(coalesce(website, ''), '^[^:]*://([^/?#]*)', 1)")} AS domain FROM companies),
addressed AS (SELECT id, region_key FROM (SELECT id, region_key, row_number() OVER (PARTITION BY id ORDER BY region_key IN {inside(DOUBTFUL)}, rank, length(token) DESC, token) AS n FROM d JOIN places ON rank < 2 AND contains({norm('address')}, word)) WHERE n = 1),
called AS (SELECT id, region_key FROM (SELECT id, region_key, row_number() OVER (PARTITION BY id ORDER BY length(phone) DESC, region_key NOT IN ('united_states', 'russia'), region_key) AS n FROM d JOIN {REGION_VALUES} ON starts_with(replace(phones, ' ', ''), phone)) WHERE n = 1),
named AS (SELECT id, region_key FROM (SELECT id, region_key, row_number() OVER (PARTITION BY id ORDER BY length(token) DESC, token, region_key) AS n
  FROM (SELECT id, string_split(domain, '.')[1] AS label FROM d) JOIN (SELECT replace(token, ' ', '') AS token, region_key FROM {PLACE_VALUES} WHERE kind = 0 AND region_key NOT IN {inside(DOUBTFUL)}) ON length(token) >= 5
  AND (starts_with(label, token) OR ends_with(label, token) OR list_contains(regexp_split_to_array(label, '[^\\p{{L}}]+'), token))) WHERE n = 1)
SELECT id, coalesce(a.region_key, c.region_key, t.region_key, s.region_key, n.region_key, '') AS country FROM d
LEFT JOIN addressed a USING (id) LEFT JOIN called c USING (id) LEFT JOIN {REGION_VALUES} ON contains(domain, '.') AND string_split(domain, '.')[-1] = t.cc AND t.cc NOT IN {inside(lookups.GENERIC_CC)}
LEFT JOIN seats s USING (id) LEFT JOIN named n USING (id)""")
def detected_country(spark, sf_dir):
    return locations.detected_country(companies(spark, sf_dir), "id", lookups.places(spark), lookups.regions(spark)).select("id", "country")


@query(f"""
WITH {SAID_SQL}, names AS (SELECT region_key, {norm('token')} AS word, token FROM {PLACE_VALUES} WHERE kind = 0),
two AS (SELECT id, name AS region, CASE WHEN way < 5 THEN 'made in ' || upper(name) WHEN way < 8 THEN 'france' WHEN way < 9 THEN '' END AS country FROM said),
r AS (SELECT id, region_key, row_number() OVER (PARTITION BY id ORDER BY length(token) DESC, token) AS n FROM two JOIN names ON contains({norm('region')}, word)),
c AS (SELECT id, region_key, row_number() OVER (PARTITION BY id ORDER BY length(token) DESC, token) AS n FROM two JOIN names ON contains({norm('country')}, word))
SELECT id, coalesce(r.region_key = c.region_key, false) AS country_matches FROM two LEFT JOIN (SELECT * FROM r WHERE n = 1) r USING (id) LEFT JOIN (SELECT * FROM c WHERE n = 1) c USING (id)""")
def same_region(spark, sf_dir):
    rows = [(n, c[1]) for n, c in enumerate(sorted(COUNTRIES))]
    numbered = spark.createDataFrame(rows, "n int, name string")
    two = table(spark, sf_dir, "customer").withColumn("n", ((F.col("c_custkey") * 7) % len(rows)).cast("int")).join(F.broadcast(numbered), "n")
    two = two.selectExpr("c_custkey AS id", "name AS region", "CASE WHEN c_custkey % 10 < 5 THEN 'made in ' || upper(name) WHEN c_custkey % 10 < 8 THEN 'france' WHEN c_custkey % 10 < 9 THEN '' END AS country")
    return locations.same_region(two, "region", "country", "id", lookups.places(spark)).select("id", "country_matches")


# --- verdicts and prompts --------------------------------------------------------------------------------------------

TASK = "Judge each company by its summary."
BATCHED_SQL = f"""
sites AS (SELECT {sql_domain(HOST)} AS domain, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1),
b AS (SELECT *, ('0x' || substr(md5(domain), 1, 8))::BIGINT % 7 AS batch, 'page ' || page_id || chr(10) || 'of ' || n AS summary FROM sites),
placed AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY domain) - 1 AS i FROM b)"""


def batched(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
    return judging.batches(pages.withColumns({"summary": F.expr("'page ' || page_id || '\n' || 'of ' || n"), "company": F.lit(None).cast("string")}), 7)


@query(f"""WITH {BATCHED_SQL} SELECT batch, '{TASK}' || chr(10) || string_agg('[' || i || '] name="" site=' || domain || ' summary="' || replace(summary, chr(10), ' ') || '"', chr(10) ORDER BY i) AS prompt FROM placed GROUP BY batch""")
def judge_prompts(spark, sf_dir):
    return judging.prompts(batched(spark, sf_dir), TASK)


@query(f"""WITH {BATCHED_SQL} SELECT domain, CASE WHEN i % 4 = 0 THEN 'yes' WHEN i % 4 = 1 THEN 'no' ELSE 'unknown' END AS verdict, CASE WHEN i % 4 < 2 THEN 'x' || i ELSE '' END AS verdict_evidence FROM placed""")
def judge_verdicts(spark, sf_dir):
    rows = batched(spark, sf_dir)
    one = F.expr("""CASE WHEN i % 4 = 0 THEN '{"i":' || i || ',"match":"no"},{"i":' || i || ',"match":" YES ","evidence":"x' || i || '"}' WHEN i % 4 = 1 THEN '{"i":' || i || ',"match":"no","evidence":"x' || i || '"}' WHEN i % 4 = 2 THEN '{"i":"none","match":"yes"}' END""")
    raw = F.concat(F.lit('Sure:\n```json\n{"results":['), F.array_join(F.collect_list(one), ","), F.lit("]}\n```"))
    answers = rows.groupBy("batch").agg(raw.alias("raw"))
    return judging.judged(rows, answers).select("domain", "verdict", "verdict_evidence")


IDENTITY, PROFILE, CAMPAIGN = {"name": "Ada"}, {"company": "Acme", "pitch": "p"}, {"description": "d"}


@query(f"""
WITH p AS (SELECT c_custkey AS id, c_custkey % 4 AS way, 'c' || c_custkey AS company, 'm' || c_custkey || '@x.com' AS email FROM customer),
q AS (SELECT *, CASE WHEN way = 0 THEN 'Full ' || id ELSE 'Given Last' END AS whom FROM p),
s AS (SELECT *, list_sum(list_transform(string_split(md5(email), ''), lambda d: ('0x' || d)::INT)) % 5 AS k FROM q)
SELECT id, concat_ws(chr(10), 'Write a first mail from Ada to ' || whom || ' at ' || company || ' (' || email || ').', 'Sender''s company: Acme', 'About the sender: d', 'Message: p',
  CASE WHEN way = 1 THEN 'Facts:' || chr(10) || company || ' builds tools for teams that ship often.' || chr(10) || 'Use one of these facts and claim nothing else; without a fitting one keep it simple.'
       WHEN way = 2 THEN 'Their website:' || chr(10) || company || ' has a website that tells of bread and butter.' || chr(10) || 'Refer to what they do there.' ELSE 'Use what you know about ' || company || '.' END,
  {strings(prompts.STRUCTURES)}[k::INT + 1], '{prompts.RULES.replace("'", "''")}') AS prompt FROM s""")
def lead_prompts(spark, sf_dir):
    way = F.col("c_custkey") % 4
    leads = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), way.alias("way"), F.concat(F.lit("c"), "c_custkey").alias("company"), F.concat(F.lit("m"), "c_custkey", F.lit("@x.com")).alias("email"),
        F.when(way == 0, F.concat(F.lit("Full "), "c_custkey")).when(way == 1, "").alias("name"), F.lit("Given").alias("first_name"), F.lit("Last").alias("last_name"),
    )
    facts = F.when(F.col("way") == 1, F.concat("company", F.lit(" builds tools for teams that ship often."))).when(F.col("way") == 3, "short")
    site = F.when(F.col("way") > 0, F.when(F.col("way") < 3, F.concat("company", F.lit(" has a website that tells of bread and butter."))).otherwise("x"))
    return leads.select("id", prompts.lead_prompt(IDENTITY, PROFILE, CAMPAIGN, facts, site, True).alias("prompt"))


# --- search, expansion, counts ---------------------------------------------------------------------------------------

CREDIBLE = f"""regexp_matches(url, '^https?://') AND domain <> '' AND len(list_filter({strings(fixed.BLOCKED_DOMAINS + fixed.DIRECTORY_DOMAINS)}, lambda b: domain = b OR ends_with(domain, '.' || b))) = 0
  AND len(list_filter({strings(fixed.BLOCKED_HOST_PARTS)}, lambda p: contains(lower({HOST}), p))) = 0"""


@query(f"""
WITH r AS (SELECT 'q' || (page_id % 5) AS query, page_id % 5 AS place, page_id AS rank, url, {sql_domain(HOST)} AS domain FROM pages),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, url) AS k FROM r), c AS (SELECT * FROM t WHERE k <= 10 AND {CREDIBLE}),
f AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY place, rank, url) AS n FROM c)
SELECT 'https://' || domain AS website, domain, url AS discovery_source_url, 'search: ' || query AS discovery_reason FROM f WHERE n = 1 ORDER BY place, rank, domain LIMIT 50""")
def query_discovery(spark, sf_dir):
    results = table(spark, sf_dir, "pages").select(F.lit("brave").alias("engine"), F.concat(F.lit("q"), F.col("page_id") % 5).alias("query"), F.col("page_id").alias("rank"), "url")
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(5)], "place int, query string")
    return search.discover_by_query(queries, results).drop("company")


PATHS = ["/about-us", "/team/login", "/contact#x", "", "/press/kit.pdf", "/x"]


@query(f"""
WITH p AS (SELECT page_id, {sql_domain(HOST)} AS domain, {HOST} AS host FROM pages), n AS (SELECT * FROM (SELECT unnest({strings(PATHS)}) AS path, generate_subscripts({strings(PATHS)}, 1) AS k)),
r AS (SELECT domain, page_id % 3 AS step, page_id * 10 + k AS rank, 'https://' || host || path AS url, lower(regexp_replace(path, '#.*', '')) AS path, lower(host) AS host FROM p, n),
f AS (SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM r WHERE len(list_filter({strings(fixed.PAGE_HINTS)}, lambda x: contains(path, x))) > 0 AND len(list_filter({strings(fixed.FILE_ENDS + fixed.PAGE_SKIPS)}, lambda x: contains(path, x))) = 0
  AND len(list_filter({strings(fixed.BLOCKED_HOST_PARTS)}, lambda x: contains(host, x))) = 0),
g AS (SELECT domain, bare, min(rank) AS rank FROM (SELECT *, min(step) OVER (PARTITION BY domain) AS first FROM f) WHERE step = first GROUP BY 1, 2)
SELECT domain, bare AS url, place FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rank, bare) AS place FROM g) WHERE place <= 6""")
def company_page_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"), urls.authority(F.col("url")).alias("host"))
    paths = pages.select("*", F.posexplode(F.array(*(F.lit(p) for p in PATHS))).alias("k", "path"))
    results = paths.select(F.col("domain").alias("company"), "domain", (F.col("page_id") % 3).alias("query_place"), (F.col("page_id") * 10 + F.col("k") + 1).alias("rank"), F.concat(F.lit("https://"), "host", "path").alias("url"))
    return search.company_page_urls(results, 6).select("domain", "url", "place")


@query(f"""
WITH t AS (SELECT 'https://r' || page_id || '.com/a b' AS target, page_id FROM pages),
l AS (SELECT page_id, unnest([1, 2]) AS rank, unnest([target, url]) AS url FROM t JOIN pages USING (page_id))
SELECT page_id, rank, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url FROM l""")
def search_results(spark, sf_dir):
    from tessera.sources import html

    own = F.replace("url", F.lit("&"), F.lit("&amp;"))
    said = F.concat(F.lit("<a class='result__a' href='//duckduckgo.com/l/?rut=1&amp;uddg=https%3A%2F%2Fr"), "page_id", F.lit(".com%2Fa%20b'>x</a><a class='nav' href='https://no.com'>no</a><a href='/settings'>s</a><a href='https://empty.com'></a><a href='"), own, F.lit("'>y</a><a href='https://r"), "page_id", F.lit(".com/a b#f'>again</a>"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("https://duckduckgo.com").alias("url"), said.alias("html"))
    return html.search_results(html.links(pages, "page_id")).select(F.col("key").alias("page_id"), "rank", "url")


@query("""
WITH t AS (SELECT DISTINCT source AS profile, lang AS term FROM documents WHERE lang <> ''), k AS (SELECT DISTINCT lang AS term FROM documents WHERE doc_id % 3 = 0 AND lang > 'e'),
p AS (SELECT profile, t.term, row_number() OVER (PARTITION BY profile ORDER BY k.term IS NULL, t.term) AS place FROM t LEFT JOIN k ON t.term = k.term)
SELECT profile, place, term || ' companies in Morocco' AS query FROM p WHERE place <= 3""")
def expansion_queries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.expansion_queries(docs.select(F.col("source").alias("profile"), F.col("lang").alias("term")), docs.filter("doc_id % 3 = 0 AND lang > 'e'").select(F.col("lang").alias("term")), " Morocco ")


@query(f"""
WITH g AS (SELECT c_custkey AS id, c_custkey % 5 AS way FROM customer)
SELECT id, CASE WHEN way = 2 THEN ['gestion', 'déchets'] WHEN way = 3 THEN ['eau' || id] ELSE ['recyclage'] END AS kept, CASE WHEN way = 2 THEN 'gestion des déchets' ELSE '' END AS phrase FROM g WHERE way IN (0, 2, 3)""")
def native_terms(spark, sf_dir):
    """Ways: an alternative list; an answer that leads back elsewhere; three words; no way back; an echo."""
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey % 5 AS way", "'recycling' || c_custkey || ' waste' AS text")
    there = t.withColumn("result", F.expr("CASE way WHEN 0 THEN 'Recyclage/reprise' WHEN 1 THEN 'fausse' || id WHEN 2 THEN 'Gestion des déchets' WHEN 3 THEN 'eau' || id ELSE text END"))
    back = spark.createDataFrame([("Recyclage", "wastes"), ("Gestion des déchets", "waste management")], "text string, result string")
    back = back.union(t.filter("way = 1").selectExpr("'fausse' || id", "'water'"))
    found = lookups.native_terms(t.select(F.col("text").alias("term")), there, back, [*fixed.NATIVE_FUNCTION_WORDS])
    return found.join(t.select(F.col("text").alias("term"), "id"), "term").select("id", "kept", "phrase")


@query("""
WITH p AS (SELECT c_custkey AS id, 'w' || (c_custkey % 50) AS term, 's' || c_custkey AS synonym FROM customer)
SELECT CASE WHEN term IN ('w1', 'w7') THEN term END AS token, synonym AS term FROM p WHERE term IN ('w1', 'w7')
UNION SELECT t, 'm' || c_custkey FROM customer, (VALUES ('w1'), ('w7')) v(t) WHERE c_custkey % 10 = 0""")
def lexicon_terms(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pairs = c.selectExpr("'w' || (c_custkey % 50) AS term", "'s' || c_custkey AS synonym").union(c.selectExpr("CASE WHEN c_custkey % 10 = 0 THEN 'w1 w7' ELSE 'w1 w8' END", "'m' || c_custkey"))
    return lookups.lexicon_terms(spark.createDataFrame([("w1",), ("w7",)], "token string"), pairs, "Makers of w1 w7")


STRONG, WEAK = ["kereste"], ["sawmill", "plywood", "timber"]


@query("""
WITH c AS (SELECT c_custkey AS id, ['Timber for all', 'kereste', 'a sawmill', 'sawmills and plywood', 'nothing'][(c_custkey % 5)::INT + 1] AS said FROM customer)
SELECT id, contains(lower(said), 'timber') OR contains(said, 'kereste') OR (contains(said, 'sawmill') AND contains(said, 'plywood')) AS confirmed, contains(said, 'kereste')::INT AS n_strong, contains(said, 'sawmill')::INT + contains(said, 'plywood')::INT AS n_weak FROM c""")
def supported_evidence(spark, sf_dir):
    said = F.element_at(F.array(*(F.lit(s) for s in ("Timber for all", "kereste", "a sawmill", "sawmills and plywood", "nothing"))), (F.col("c_custkey") % 5).cast("int") + 1)
    found = icp.supported(said, icp.parse("timber companies"), "timber companies", STRONG, WEAK)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), found["confirmed"].alias("confirmed"), F.size(found["strong"]).alias("n_strong"), F.size(found["weak"]).alias("n_weak"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (c_custkey % 3 = 1) AS with_email, count(*) FILTER (c_mktsegment < 'C') AS with_phone, 0 AS with_profile FROM customer""")
def company_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("CASE c_custkey % 3 WHEN 1 THEN 'a@b.c' WHEN 2 THEN '' END AS email", "CASE WHEN c_mktsegment < 'C' THEN '+1' ELSE '' END AS phone", "'' AS linkedin_company_url")
    return engine.company_counts(rows)


@query("""SELECT count(*) AS n_rows, count(*) FILTER (c_custkey % 7 <> 0) AS n_written FROM customer""")
def draft_counts(spark, sf_dir):
    return engine.draft_counts(table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 7 = 0 THEN 'ERROR: no answer' WHEN c_custkey % 7 = 1 THEN NULL ELSE 'text' END AS generated_email"))
