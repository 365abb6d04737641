"""Whole flows over rows made from the customers: enrichment of sites, discovery, employment, contacts. A site and up to two pages each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators import employment, people, seeds
from tessera.plans import engine
from tessera.plans.catalogue import SIGNAL, query, table
from tessera.sources import organisations

# --- sites and their pages: six ways to answer -------------------------------------------------------------------------

SITE = "CASE k % 8 WHEN 7 THEN 'https://army' || k || '.mil' ELSE 'https://c' || k || '.com' END"
META = "'Firm ' || k || ' builds wood machines for ' || seg || ' works in many lands.'"
HEAD = "'Firm ' || k || ' and wood machines since nineteen hundred'"
BODY = "'Our people help ' || seg || ' works with wood machines every day of the year.'"
MORE = "'Firm ' || k || ' offers service and parts for all machines it has made.'"
BASE = f"SELECT *, {SITE} AS site FROM (SELECT c_custkey AS k, c_custkey % 6 AS way, lower(c_mktsegment) AS seg FROM customer)"


def customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_custkey % 6 AS way", "lower(c_mktsegment) AS seg")
    return c.withColumn("site", F.expr(SITE))


def captured(c):
    """Pages (url, html): nothing of way 0, an empty page of way 2, one with next to no text of way 1, and facts of the others."""
    home = f"""CASE way WHEN 1 THEN '<main><p>Short.</p></main>' WHEN 2 THEN ''
      WHEN 4 THEN '<title>x</title><main><h1>' || {HEAD} || '</h1><p>' || {BODY} || '</p></main>'
      ELSE '<head><meta name="description" content="' || {META} || '"></head><nav>no</nav><main><p>' || {META} || ' Short.</p></main>' END"""
    first = c.filter("way > 0").select(F.col("site").alias("url"), F.expr(home).alias("html"))
    second = c.filter("way = 4").select(F.concat("site", F.lit("/about/")).alias("url"), F.expr(f"'<main><p>' || {MORE} || '</p><p>' || {BODY} || '</p></main>'").alias("html"))
    return first.union(second)


ENRICHED = f"""
c AS ({BASE}),
f AS (SELECT k, page, part, source_type, fact FROM (
  SELECT k, 0 AS page, 0 AS part, 'meta' AS source_type, {META} AS fact FROM c WHERE way IN (3, 5)
  UNION ALL SELECT k, 0, 1, 'heading', {HEAD} FROM c WHERE way = 4
  UNION ALL SELECT k, 0, 2, 'body', {BODY} FROM c WHERE way = 4
  UNION ALL SELECT k, 1, 0, 'body', {MORE} FROM c WHERE way = 4) q WHERE length(fact) BETWEEN 35 AND 240 AND NOT regexp_matches(fact, '{fixed.FACT_NOISE}')),
g AS (SELECT *, greatest(0.05::DOUBLE, least(0.25::DOUBLE + CASE source_type WHEN 'meta' THEN 0.35::DOUBLE WHEN 'heading' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(fact, '{fixed.FACT_VERBS}') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN length(fact) BETWEEN 45 AND 180 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN page = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 0.95::DOUBLE)) AS conf FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY conf DESC, page, part) AS place FROM g),
a AS (SELECT k, count(*) AS n, list(fact ORDER BY place) AS facts, list_reduce(list(conf ORDER BY place), lambda x, y: x + y) AS total FROM p GROUP BY k),
s AS (SELECT c.*, way IN (1, 3, 4, 5) AS ok, coalesce(n, 0) AS n, coalesce(array_to_string(facts, ' | '), '') AS facts, coalesce(facts[1], '') AS summary, CASE WHEN n > 0 THEN least(100, round_even(total / n * 70 + least(8 * n, 30), 0))::INTEGER ELSE 0 END AS pers FROM c LEFT JOIN a USING (k))"""


@query(f"""
WITH {ENRICHED}
SELECT site, CASE WHEN ok THEN 'ok' ELSE 'fetch_failed' END AS website_status, summary AS company_summary, facts AS personalization_facts, pers::VARCHAR AS personalization_score,
  concat_ws(' | ', CASE WHEN NOT ok THEN 'website_fetch_failed' END, CASE WHEN n = 0 THEN 'no_grounded_facts' WHEN pers < 55 THEN 'low_personalization_confidence' END) AS quality_warnings FROM s""")
def enriched_customers(spark, sf_dir):
    c = customers(spark, sf_dir)
    done = engine.enrich(c.select("site"), captured(c))
    return done.select("site", "website_status", "company_summary", "personalization_facts", "personalization_score", "quality_warnings")


# --- discovery: scores, verdicts and bands ------------------------------------------------------------------------------

KEEP = 60


@query(f"""
WITH {ENRICHED},
e AS (SELECT *, contains(facts, 'wood machines') AS confirmed, substr(site, 9) AS domain, (k % 3) * 25 AS fit, k % 3 > 0 AS anchor, CASE k % 11 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' ELSE 'unknown' END AS verdict, k % 5 = 0 AS mailed FROM s),
i AS (SELECT *, CASE WHEN ok THEN 35 ELSE 15 END + CASE WHEN confirmed THEN 18 + 28 ELSE 0 END AS icp FROM e),
l AS (SELECT *, greatest(0, least(100, 30 + CASE WHEN ok THEN 10 ELSE -15 END + least(icp // 4, 20) + least(pers // 6, 15) + CASE WHEN mailed THEN 12 ELSE 0 END + least(fit // 5, 18) - CASE WHEN fit = 0 THEN 15 ELSE 0 END + CASE WHEN {SIGNAL.replace("(facts", "(summary || ' ' || facts")} THEN 6 ELSE 0 END))::INTEGER AS lead_score,
  CASE WHEN ends_with(domain, '.mil') OR verdict = 'no' THEN 'rejected' WHEN (confirmed OR verdict = 'yes') AND anchor THEN 'verified' ELSE 'review' END AS match_confidence,
  CASE WHEN ends_with(domain, '.mil') THEN 'government_site' WHEN verdict = 'no' THEN 'llm_mismatch:different company' WHEN (confirmed OR verdict = 'yes') AND anchor THEN 'icp+region_confirmed' || CASE WHEN verdict = 'yes' THEN '+llm' ELSE '' END WHEN NOT (confirmed OR verdict = 'yes') THEN 'icp_unconfirmed' ELSE 'region_unconfirmed' END AS verification FROM i),
o AS (SELECT *, CASE match_confidence WHEN 'verified' THEN 0 WHEN 'review' THEN 1 ELSE 2 END AS band FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY band > 0 ORDER BY band, lead_score DESC, domain) AS nth FROM o QUALIFY nth <= {KEEP})
SELECT domain, icp AS icp_score, lead_score, match_confidence, verification, row_number() OVER (ORDER BY band, lead_score DESC, domain)::INTEGER AS place FROM r""")
def discovered_customers(spark, sf_dir):
    c = customers(spark, sf_dir)
    rows = c.select(F.concat(F.lit("Firm "), "k").alias("company"), F.col("site").alias("website"), F.substring("site", 9, 1 << 30).alias("domain"), (F.col("k") % 3 * 25).cast("int").alias("region_fit"), (F.col("k") % 3 > 0).alias("region_anchor"), F.expr("CASE k % 11 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' ELSE 'unknown' END").alias("verdict"))
    rows = rows.withColumns({"verdict_evidence": F.lit(""), "email": F.when(F.regexp_extract("company", "([0-9]+)", 1).cast("int") % 5 == 0, F.concat(F.lit("info@"), "domain")).otherwise("")})
    done = engine.discover(rows, captured(c), "wood machines", KEEP)
    return done.select("domain", "icp_score", "lead_score", "match_confidence", "verification", "place")


# --- employment: ten kinds of results ----------------------------------------------------------------------------------

RESULTS = [  # way, engine, on a profile, title, snippet
    (0, "ddgs", True, "Ann Lee - Sales - {} | LinkedIn", "Jan 2020 - Present"),
    (1, "ddgs", True, "Ann Lee - Sales - {} | LinkedIn", "{} Jan 2019 - Mar 2021"),
    (2, "ddgs", True, "Ann Lee - Sales - {} | LinkedIn", ""),
    (3, "ddgs", True, "Ann Lee - Sales - Beta Works | LinkedIn", ""),
    (4, "site", False, "About us", "Ann Lee works for {}"),
    (5, "ddgs", True, "Ann Lee - Sales - Beta Works | LinkedIn", ""),
    (5, "serper", True, "Ann Lee - Sales - {} | LinkedIn", ""),
    (6, "ddgs", True, "Ann Lee - {}", "Ann joined Gamma Works last year"),
    (8, "ddgs", True, "Ann Lee - {}", "open to work"),
    (9, "ddgs", False, "Other things", "nothing to see"),
]
WHY = {0: "current_dates", 1: "past_dates", 2: "confirmed", 3: "contradicted", 4: "confirmed", 5: "inconclusive", 6: "moved", 7: "no_results", 8: "not_employed", 9: "unconfirmed"}


@query(f"""SELECT 'P' || c_custkey AS person, c_custkey % 10 IN (0, 2, 4, 5, 7) AS is_current, [{", ".join(f"'{w}'" for w in WHY.values())}][(c_custkey % 10)::INT + 1] AS why FROM customer""")
def employed_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("'P' || c_custkey AS person", "'Acme' || c_custkey AS company", "c_custkey % 10 AS way")
    made = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(e).alias("engine"), F.lit("https://www.linkedin.com/in/x" if p else "https://acme.com/about").alias("url"), F.lit(t).alias("title"), F.lit(s).alias("snippet"), F.lit(1).alias("rank")) for w, e, p, t, s in RESULTS))
    rows = c.select("person", "company", "way", F.explode(made).alias("r")).filter("way = r.w").select("person", "company", "r.engine", "r.url", "r.rank", *(F.replace(F.col(f"r.{x}"), F.lit("{}"), F.col("company")).alias(x) for x in ("title", "snippet")))
    return employment.ladder(employment.signals(rows), c).select("person", "is_current", "why")


# --- contacts of sites ---------------------------------------------------------------------------------------------------


@query(f"""
WITH c AS ({BASE}),
x AS (SELECT site, k % 5 AS kind, substr(site, 9) AS dom FROM c)
SELECT site, CASE kind WHEN 0 THEN 'public_email' WHEN 1 THEN 'public_person' WHEN 2 THEN 'contact_page' WHEN 3 THEN 'not_found' ELSE 'role_inbox' END AS contact_type,
  CASE kind WHEN 0 THEN 'jane.doe@' || dom WHEN 4 THEN 'press@' || dom ELSE '' END AS email, CASE kind WHEN 0 THEN 'Jane Doe' WHEN 1 THEN 'Jane Miller' ELSE '' END AS name,
  CASE kind WHEN 0 THEN site WHEN 1 THEN site WHEN 2 THEN site || '/contact' WHEN 4 THEN site || '/team' ELSE '' END AS source_url FROM x""")
def contacts_of_customers(spark, sf_dir):
    c = customers(spark, sf_dir).withColumns({"kind": F.col("k") % 5, "dom": F.substring("site", 9, 1 << 30)})
    home = c.select("site", F.lit(0).alias("page"), F.col("site").alias("url"), F.expr("CASE kind WHEN 0 THEN 'write to info@' || dom || ' or jane.doe@' || dom WHEN 1 THEN 'our founder: Jane Miller' WHEN 3 THEN 'me@gmail.com' ELSE 'x' END").alias("text"))
    second = c.filter("kind IN (2, 4)").select("site", F.lit(1).alias("page"), F.expr("site || CASE kind WHEN 2 THEN '/contact' ELSE '/team' END").alias("url"), F.expr("CASE kind WHEN 4 THEN 'for the press: press@' || dom ELSE 'call us' END").alias("text"))
    return people.site_contact(home.union(second)).select("site", "contact_type", "email", "name", "source_url")


@query(f"""
WITH c AS ({BASE}),
p(page, path) AS (SELECT unnest(range(5)), unnest(['', '/about', '/contact', '/team', '/founders']))
SELECT site, page::INTEGER AS page, site || path AS url, 'Page ' || page || ' of ' || k AS text FROM c, p WHERE (k + page) % 3 > 0""")
def contact_crawl(spark, sf_dir):
    c = customers(spark, sf_dir)
    paths = F.array(*map(F.lit, fixed.CONTACT_PATHS))
    pages = c.select("site", "k", F.posexplode(paths).alias("page", "path")).withColumn("html", F.expr("CASE (k + page) % 3 WHEN 0 THEN '' ELSE '<main><p>Page ' || page || ' of ' || k || '</p></main>' END"))
    found = engine.contact_pages(c.select("site"), pages.select(F.concat("site", "path", F.lit("/")).alias("url"), "html"))
    return found.select("site", "page", "url", "text")


# --- seeds of a model, and profiles of companies -----------------------------------------------------------------------


@query("""
WITH c AS (SELECT c_custkey AS k FROM customer),
r AS (SELECT k, 'company' AS kind, unnest(range(3)) AS pos, unnest(['Alpha ' || k, 'Beta', 'Gamma ' || (k % 7)]) AS name FROM c WHERE k % 4 < 3
      UNION ALL SELECT k, 'directory', 0, 'Chamber ' || k FROM c WHERE k % 4 < 3)
SELECT k AS profile, kind, pos::INTEGER AS pos, name FROM r""")
def model_seeds(spark, sf_dir):
    raw = F.expr("""CASE k % 4 WHEN 0 THEN '```json\n{"companies": [" Alpha ' || k || '", "Beta", 5, "", null, "BETA", "Gamma ' || (k % 7) || '"], "local_directories": ["Chamber ' || k || '", {}]}\n```'
      WHEN 1 THEN 'Sure: {"companies": ["Alpha ' || k || '", "Beta", "Gamma ' || (k % 7) || '"], "local_directories": ["Chamber ' || k || '"], "more": {"x": 1}} as asked.' WHEN 2 THEN '{"local_directories": ["Chamber ' || k || '"], "companies": ["Alpha ' || k || '", "Beta", "beta", "Gamma ' || (k % 7) || '"]}'
      ELSE 'No { such thing' END""")
    return seeds.seeds(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select(F.col("k").alias("profile"), raw.alias("raw")))


@query("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS way FROM customer)
SELECT 'Firm ' || k || ' Ltd' AS company, CASE way WHEN 0 THEN 'https://linkedin.com/company/own' || k WHEN 1 THEN 'https://www.linkedin.com/company/firm-' || k WHEN 2 THEN CASE WHEN k > 9 THEN 'https://de.linkedin.com/company/f' || k ELSE '' END ELSE '' END AS profile FROM c""")
def profiles_of_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_custkey % 5 AS way", "'Firm ' || c_custkey || ' Ltd' AS company", "'f' || c_custkey || '.com' AS domain")
    # way 3 fits only beyond the results that are looked at, way 4 has other companies and persons
    urls_ = F.expr("""CASE way WHEN 1 THEN array('https://x.com', 'https://www.linkedin.com/company/other-name', 'https://www.linkedin.com/company/firm-' || k || '?x=1') WHEN 2 THEN array('https://de.linkedin.com/company/f' || k || '/about')
      WHEN 3 THEN array('a', 'b', 'c', 'd', 'e', 'https://www.linkedin.com/company/firm-' || k) WHEN 4 THEN array('https://www.linkedin.com/in/firm-' || k, 'https://www.linkedin.com/company/nobody') ELSE array('https://www.linkedin.com/company/firm-' || k) END""")
    results = c.select("company", "domain", F.posexplode(urls_).alias("rank", "url"))
    own = c.select("company", "domain", F.expr("CASE way WHEN 0 THEN 'https://linkedin.com/company/own' || k ELSE '' END").alias("profile"))
    return people.company_profiles(own, results).select("company", "profile")


# --- structured data of organisations --------------------------------------------------------------------------------------

ORG_HTML = """CASE way WHEN 0 THEN '<script type="application/ld+json">{"@graph": [{"name": " "}, {"name": "Firm ' || k || ' Ltd", "email": "mailto:Hi@' || dom || '", "telephone": "+49 30 90' || (k + 10000) || '", "address": {"streetAddress": "Main ' || k || '", "postalCode": ' || (k + 10000) || ', "addressCountry": {"name": "DE"}}, "sameAs": ["https://x.com/f' || k || '?a=b", 5, "https://de.linkedin.com/company/firm-' || k || '/about"]}]}</script><a href="mailto:HI@' || dom || '?x=1">m</a>'
  WHEN 1 THEN '<script type="application/ld+json">no json</script><a href="mailto:two@other.org">m</a><a href="tel:0301 ' || (k + 10000) || '">t</a><a href="/partners#x">p</a><p>text@' || dom || '</p>'
  WHEN 2 THEN '<p>Write to Me@' || dom || ' or you@' || dom || ' or x@other.org</p><a href="https://www.facebook.com/f' || k || '?r=1">f</a>'
  WHEN 3 THEN '<script type="application/ld+json">[{"name": "List ' || k || '", "address": " Street ' || k || ' ", "sameAs": "https://youtube.com/c' || k || '"}, 7]</script>' ELSE NULL END"""


@query(f"""
WITH c AS (SELECT k, k % 5 AS way, site, substr(site, 9) AS dom FROM ({BASE}))
SELECT site, CASE way WHEN 0 THEN 'Firm ' || k || ' Ltd' WHEN 3 THEN 'List ' || k ELSE '' END AS name, CASE way WHEN 0 THEN 'Main ' || k || ', ' || (k + 10000) || ', DE' WHEN 3 THEN 'Street ' || k ELSE '' END AS address,
  CASE way WHEN 0 THEN 'hi@' || dom WHEN 1 THEN 'two@other.org' WHEN 2 THEN 'me@' || dom || ',you@' || dom || ',late@' || dom ELSE 'late@' || dom END AS emails,
  CASE way WHEN 0 THEN '+493090' || (k + 10000) WHEN 1 THEN '0301' || (k + 10000) ELSE '' END AS phones,
  CASE way WHEN 0 THEN 'https://x.com/f' || k || ',https://de.linkedin.com/company/firm-' || k WHEN 2 THEN 'https://www.facebook.com/f' || k WHEN 3 THEN 'https://youtube.com/c' || k ELSE '' END AS socials,
  CASE way WHEN 0 THEN 'https://de.linkedin.com/company/firm-' || k ELSE '' END AS profile, CASE way WHEN 1 THEN site || '/partners' ELSE '' END AS partner_page FROM c""")
def organisation_contacts(spark, sf_dir):
    c = customers(spark, sf_dir).withColumns({"way": F.col("k") % 5, "dom": F.substring("site", 9, 1 << 30)})
    home = c.select("site", F.lit(0).alias("page"), F.col("site").alias("url"), F.expr(ORG_HTML).alias("html"))
    # the second page has an address as a link where the first has one in its text or none at all
    second = c.filter("way > 1").select("site", F.lit(1), F.concat("site", F.lit("/contact")), F.expr("'<a href=\"mailto:late@' || dom || '\">m</a><p>never@' || dom || '</p>'"))
    joined = lambda n: F.array_join(n, ",").alias(n)
    return organisations.contact_bundle(home.union(second)).select("site", "name", "address", joined("emails"), joined("phones"), joined("socials"), "profile", "partner_page")
