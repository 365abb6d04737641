"""Queries of companies found through source pages, and of lead tables before and after a run, over rows made from the customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import harvest, lookups
from tessera.plans.catalogue import query, table
from tessera.sources import files, html

# --- sources: a list page each, with links out, to pages of its own, and to nothing of use ------------------------------

PER_SOURCE, LIMIT = 3, 30


def lists(spark, sf_dir):
    """Sources (source, rank) and the captured pages (url, html); every fifth source and some pages below were not captured."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k")
    a = lambda href, said: f"'<a href=\"' || {href} || '\">' || {said} || '</a>'"
    out = a("'https://firm' || k % 7 || '.io/x'", "'Firm ' || k % 7")
    many = " || ".join(a(f"'https://{w.lower()}' || k || '.com'", f"'{w} ' || k") for w in ("Extra", "Plus", "Late"))
    own = " || ".join([
        a("'/company/d' || k", "'View'"), a("'/company/d' || k || '/?q=1#x'", "'Firm page'"), a("'https://www.list' || k || '.com/more-' || k || '/'", "'More firms'"),
        a("'/about'", "'About all'"), a("'/go-' || k", "'Visit'"), a("'/'", "'Home page'"), a("'https://www.linkedin.com/company/z'", "'Profile'"), a("'mailto:x@list.com'", "'Write'"),
    ])
    first = c.filter("k % 5 <> 0").select(F.expr("'https://www.list' || k || '.com'").alias("url"), F.expr(f"'<body>' || {out} || CASE WHEN k % 3 = 0 THEN {many} ELSE '' END || {own}").alias("html"))
    detail = c.filter("k % 4 <> 1").select(F.expr("'https://www.list' || k || '.com/company/d' || k"), F.expr(a("'https://own' || k || '.com'", "'Visit website'") + " || " + out))
    more = c.select(F.expr("'https://www.list' || k || '.com/more-' || k"), F.expr(a("'https://twin' || k || '.net'", "'Twin ' || k") + " || " + a("'https://pair' || k || '.net'", "'Pair ' || k")))
    return c.selectExpr("'www.list' || k || '.com/' AS source", "k AS rank"), first.union(detail).union(more)


NAMED = f"""
c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0),
n AS (SELECT k, 0 AS i, 'Firm ' || k % 7 AS company, 'firm' || k % 7 || '.io' AS domain, '' AS tail FROM c
  UNION ALL SELECT k, i, w || ' ' || k, lower(w) || k || '.com', '' FROM c, (VALUES (1, 'Extra'), (2, 'Plus'), (3, 'Late')) v(i, w) WHERE k % 3 = 0
  UNION ALL SELECT k, 10, 'Own' || k, 'own' || k || '.com', '/company/d' || k FROM c WHERE k % 3 <> 0 AND k % 4 <> 1
  UNION ALL SELECT k, i, w || ' ' || k, lower(w) || k || '.net', '/more-' || k FROM c, (VALUES (20, 'Twin'), (21, 'Pair')) v(i, w) WHERE k % 3 <> 0),
s AS (SELECT k, 'www.list' || k || '.com/' AS source, row_number() OVER (PARTITION BY k ORDER BY i) AS place, company, 'https://' || domain AS website, domain, 'https://www.list' || k || '.com' || tail AS discovery_source_url
  FROM n QUALIFY place <= {PER_SOURCE})"""


@query(f"WITH {NAMED} SELECT source, place::INTEGER AS place, company, website, domain, discovery_source_url FROM s")
def source_companies(spark, sf_dir):
    return harvest.from_sources(*lists(spark, sf_dir), PER_SOURCE).withColumn("place", F.col("place").cast("int"))


@query(f"""WITH {NAMED} SELECT source, place::INTEGER AS place, company, website, domain, discovery_source_url FROM
  (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY domain ORDER BY k, place) = 1) ORDER BY k, place LIMIT {harvest.pool_size(LIMIT)}""")
def source_pool(spark, sf_dir):
    sources, pages = lists(spark, sf_dir)
    return harvest.pool(harvest.from_sources(sources, pages, PER_SOURCE), sources, LIMIT).withColumn("place", F.col("place").cast("int"))


@query("""SELECT page, href FROM (SELECT 'https://www.list' || c_custkey || '.com' AS page, unnest(['/company/d' || c_custkey, '/more-' || c_custkey]) AS tail, 'https://www.list' || c_custkey || '.com' || tail AS href FROM customer WHERE c_custkey % 5 <> 0)""")
def detail_pages(spark, sf_dir):
    pages = lists(spark, sf_dir)[1].filter("url LIKE '%.com'")
    return html.detail_links(html.links(pages, "url")).select(F.col("key").alias("page"), "href")


# --- lead tables: names, addresses, websites and drafts in several states -------------------------------------------------

LEADS = """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN ' ' END AS name, CASE WHEN c_custkey % 4 = 1 THEN 'Ann ' END AS first_name, CASE WHEN c_custkey % 8 = 1 THEN 'Lee' END AS last_name,
  CASE c_custkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'no address' WHEN 2 THEN 'a' || c_custkey || '@gone.example' ELSE 'a' || c_custkey || '@firm.example' END AS email,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'firm' || c_custkey || '.example' END AS website, CASE WHEN c_custkey % 3 = 0 THEN 'low | short' END AS quality_warnings,
  CASE c_custkey % 6 WHEN 0 THEN 'ERROR: no answer' WHEN 1 THEN 'ERROR: none' WHEN 2 THEN '' ELSE 'Hello' END AS generated_email, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 100)::VARCHAR END AS personalization_score FROM customer"""


def leads(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("lead_customers")
    return spark.sql(LEADS.replace("(c_custkey % 100)::VARCHAR", "CAST(c_custkey % 100 AS STRING)").replace("FROM customer", "FROM lead_customers"))


@query(f"""WITH l AS ({LEADS}), r AS (SELECT count(*) AS n_rows, count(*) FILTER (trim(email) = '') AS no_email, count(*) FILTER (coalesce(trim(website), '') = '') AS no_website, count(*) FILTER (coalesce(trim(website), '') <> '') AS kept FROM l)
  SELECT allowed, n_rows, no_email, no_website, CASE WHEN allowed OR no_email = 0 THEN kept ELSE 0 END AS n_kept, true AS has_website, CASE WHEN NOT allowed AND no_email > 0 THEN 'missing_email' WHEN kept = 0 THEN 'no_rows_left' ELSE '' END AS problem FROM r, (VALUES (true), (false)) v(allowed)""")
def lead_reports(spark, sf_dir):
    rows = leads(spark, sf_dir)
    return files.lead_report(rows, True).withColumn("allowed", F.lit(True)).unionByName(files.lead_report(rows).withColumn("allowed", F.lit(False)))


@query(f"""SELECT * FROM (SELECT CASE WHEN trim(coalesce(name, '')) <> '' THEN trim(name) WHEN first_name IS NOT NULL THEN concat_ws(' ', trim(first_name), last_name) ELSE email END AS label, email,
  coalesce(personalization_score, 'n/a') AS score, concat_ws(' | ', quality_warnings, CASE WHEN generated_email LIKE 'ERROR:%' THEN 'generation_failed' END) AS warnings FROM ({LEADS})) WHERE warnings <> ''""")
def lead_issues(spark, sf_dir):
    return files.issues(leads(spark, sf_dir))


@query(f"""SELECT k, email FROM ({LEADS}) WHERE email <> '' AND generated_email <> '' AND generated_email NOT LIKE 'ERROR:%'""")
def sendable_drafts(spark, sf_dir):
    return files.sendable(leads(spark, sf_dir)).select("k", "email")


@query(f"""SELECT k, email, CASE WHEN trim(email) = '' THEN 'empty' WHEN email NOT LIKE '%@%' THEN 'invalid format' WHEN email LIKE '%@gone.example' THEN 'no MX record for gone.example' ELSE 'ok' END AS reason FROM ({LEADS})""")
def verified_leads(spark, sf_dir):
    servers = spark.createDataFrame([("gone.example", False), ("Firm.example", True)], "domain string, has_mx boolean")
    return lookups.verify_emails(leads(spark, sf_dir), "email", servers).select("k", "email", "reason")
