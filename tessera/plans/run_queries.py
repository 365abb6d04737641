"""Queries of search answers, names, drafts and exported tables, over rows made from the customers: each with SQL that computes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import contacts, drafts, fixed, prompts
from tessera.operators import ranking, search
from tessera.plans import engine
from tessera.plans.catalogue import literal, query, table
from tessera.sources import files
from tessera.sources.scratch import folder


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS k")


def crossed(spark, c, rows, names):
    """Each customer with each of a few fixed rows, without a join."""
    fields = [n.strip() for n in names.split(",")]
    items = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(fields, r, strict=True))) for r in rows))
    return c.select("k", F.inline(items))


# --- search answers: engines that fail for some queries, sites that fit a name or do not ---------------------------------

ANSWERS = [(e, least, r) for e, least in (("ddgs", 3), ("brave", 2), ("ddg_html", 1), ("unheard", 0)) for r in (1, 2, 3)]
NUM = 2


@query(f"""WITH r AS (SELECT 'firms ' || c_custkey AS query, engine, rank, 'https://' || replace(engine, '_', '') || rank || '.org/' || c_custkey AS url, least FROM customer, {literal(ANSWERS, "engine, least, rank")}
  WHERE c_custkey % 4 >= least AND engine <> 'unheard') SELECT query, engine, rank, url FROM r QUALIFY least = max(least) OVER (PARTITION BY query) AND rank <= {NUM}""")
def search_answers(spark, sf_dir):
    r = crossed(spark, customers(spark, sf_dir), ANSWERS, "engine, least, rank").filter("k % 4 >= least")
    shown = r.selectExpr("concat('firms ', k) AS query", "engine", "rank", "concat('https://', replace(engine, '_', ''), rank, '.org/', k) AS url")
    return search.cascade(shown, NUM).select("query", "engine", "rank", "url")


HITS = [(0, 1, "https://www.linkedin.com/company/firm{k}", 3), (0, 2, "https://newsroom.org/{k}", 2), (0, 3, "https://later.org/{k}", 2), (1, 1, "https://www.firm{k}.io/x", 1), (2, 1, "https://firm{k}.de", 1)]


@query("""SELECT 'Firm ' || c_custkey AS company, 'https://' || CASE c_custkey % 3 WHEN 0 THEN 'firm' || c_custkey || '.io' ELSE 'newsroom.org' END AS website, false AS in_de FROM customer WHERE c_custkey % 3 < 2
  UNION ALL SELECT 'Firm ' || c_custkey, 'https://firm' || c_custkey || '.de', true FROM customer WHERE c_custkey % 3 = 0""")
def resolved_sites(spark, sf_dir):
    hits = crossed(spark, customers(spark, sf_dir), HITS, "query_place, rank, url, until").filter("k % 3 < until")
    hits = hits.filter("until <> 1 OR k % 3 = 0").select(F.concat(F.lit("Firm "), "k").alias("company"), "query_place", "rank", F.replace("url", F.lit("{k}"), F.col("k").cast("string")).alias("url"))
    free, strict = search.resolve_websites(hits), search.resolve_websites(hits, require_match=True, country="de")
    return free.withColumn("in_de", F.lit(False)).unionByName(strict.withColumn("in_de", F.lit(True)))


@query("""SELECT 's' || c_custkey || '.com' AS site, 'https://s' || c_custkey || '.com' || tail AS url, kind FROM customer, (VALUES ('/a/', 'base'), ('', 'base'), ('/b', 'extra')) v(tail, kind)""")
def merged_pages(spark, sf_dir):
    made = lambda rows: crossed(spark, customers(spark, sf_dir), rows, "tail, kind").selectExpr("concat('s', k, '.com') AS site", "concat('https://s', k, '.com', tail) AS url", "kind")
    return search.merge_pages(made([("/a/", "base"), ("", "base")]), made([("/a", "extra"), ("/", "extra"), ("/b", "extra")]))


# --- names and ranks -------------------------------------------------------------------------------------------------------


@query("""SELECT k, ['ann.lee' || k || '@', 'ann@', 'annlee' || k || '@', 'alee' || k || '@', 'annl@', 'a.lee' || k || '@', 'lee' || k || '.ann@', 'ann_lee' || k || '@', 'ann-lee' || k || '@'] AS patterns,
  k % 2 = 0 AS fits, k % 3 = 0 AS slug, ['firm', k::VARCHAR] AS tokens FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey >= 10)""")
def name_forms(spark, sf_dir):
    c = customers(spark, sf_dir).filter("k >= 10")
    name, own = F.concat(F.lit("FIRM "), "k", F.lit(" GmbH")), F.concat(F.lit("firm"), "k", F.lit(".io"))
    url = F.when(F.col("k") % 3 == 0, F.concat(F.lit("https://linkedin.com/company/the-firm-"), "k", F.lit("//"))).when(F.col("k") % 3 == 1, "https://linkedin.com/company/fi/").otherwise("https://linkedin.com/company/other")
    return c.select(
        "k", contacts.email_patterns(F.lit("ann"), F.concat(F.lit("lee"), "k"), F.lit("")).alias("patterns"), contacts.domain_fits_company(F.when(F.col("k") % 2 == 0, own).otherwise("other.net"), name).alias("fits"),
        contacts.slug_fits(url, name, own).alias("slug"), contacts.company_tokens(name).alias("tokens"),
    )


SCORED = "CASE {k} % 5 WHEN 0 THEN NULL WHEN 1 THEN 'none' ELSE CAST({k} % 7 AS {t}) END AS lead_score, CAST({k} % 4 AS {t}) AS contact_score, {k} % 3 AS icp_score, {k} % 11 AS personalization_score"
MOST = 60


@query(f"""SELECT k, rank::INTEGER AS rank FROM (SELECT k, row_number() OVER (ORDER BY coalesce(try_cast(lead_score AS INTEGER), 0) DESC, contact_score::INTEGER DESC, icp_score DESC, personalization_score DESC, k) AS rank
  FROM (SELECT c_custkey AS k, {SCORED.format(k='c_custkey', t='VARCHAR')} FROM customer)) WHERE rank <= {MOST}""")
def people_ranking(spark, sf_dir):
    scored = customers(spark, sf_dir).selectExpr("k", *SCORED.format(k="k", t="STRING").split(", "))
    best = ranking.people_rank(scored, MOST, "k").agg(F.collect_list("k").alias("ks"))  # MOST rows in their order
    return best.select(F.posexplode("ks").alias("rank", "k")).select("k", (F.col("rank") + 1).alias("rank"))


# --- drafts and tables ------------------------------------------------------------------------------------------------------

FACTS = "Firm builds machines for works"
BODY = "Your machines help many works.\n\nWe make parts for them in a week.\n\nWould a list of parts help you?"


@query(f"""WITH l AS (SELECT c_custkey AS k, c_custkey % 4 AS way, CASE WHEN c_custkey % 3 = 0 THEN 'low' END AS before FROM customer)
SELECT k, CASE WHEN way IN (1, 2) THEN 'Parts for firm ' || k ELSE '' END AS generated_subject, CASE way WHEN 0 THEN 'ERROR: no answer' WHEN 3 THEN 'Only one line for ' || k ELSE '{BODY}' END AS generated_email,
  concat_ws(' | ', before, CASE way WHEN 0 THEN 'generation_failed' WHEN 2 THEN 'no_grounded_facts_available' WHEN 3 THEN 'missing_subject | not_three_paragraphs | no_grounded_fact_used' END) AS quality_warnings FROM l""")
def drafted_leads(spark, sf_dir):
    leads = customers(spark, sf_dir).selectExpr("k", "CASE WHEN k % 4 <> 2 THEN '" + FACTS + "' END AS personalization_facts", "CASE WHEN k % 3 = 0 THEN 'low' END AS quality_warnings")
    answer = F.when(F.col("k") % 4 == 3, F.concat(F.lit("Only one line for "), "k")).otherwise(F.concat(F.lit("Subject: Parts for firm "), "k", F.lit(".\n\n" + BODY)))
    answers = leads.filter("k % 4 > 0").select("k", answer.alias("raw"))
    again = leads.filter("k % 4 = 2").select("k", F.lit("Z: a later answer").alias("raw"))  # one answer a key counts
    return engine.draft(leads, answers.union(again), "k").select("k", "generated_subject", "generated_email", "quality_warnings")


@query(f"""SELECT c_custkey AS k, 'Write a first mail from Kim to ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Ann ' || c_custkey END || ' at Firm ' || c_custkey || ', with what you know about the company. {prompts.SHORT_RULES}' AS prompt,
  'Hi ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END || ' of Firm ' || c_custkey || '!' AS filled, 'ERROR: no column city' AS wrong FROM customer""")
def short_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name", "'Ann' AS first_name", "CAST(c_custkey AS STRING) AS last_name", "concat('Firm ', c_custkey) AS company")
    render = lambda t: drafts.render(t, c.columns)
    return c.select("k", prompts.template_prompt({"name": "Kim"}).alias("prompt"), render("Hi {name} of {company}!").alias("filled"), render("Hi {name} in {city}!").alias("wrong"))


EXPORTED = ["company", "email", "name", "phone", "lead_score", "match_confidence", "company_summary"]


@query("""SELECT 'Firm "' || c_custkey || '", Inc' AS company, 'a' || c_custkey || '@firm.example' AS email, '' AS name, CASE WHEN c_custkey % 2 = 0 THEN '+49 30 ' || c_custkey ELSE '' END AS phone, (c_custkey % 90)::VARCHAR AS lead_score,
  CASE WHEN c_custkey % 3 = 0 THEN 'verified' ELSE 'review' END AS match_confidence, 'One' || chr(10) || 'two, "three"' AS company_summary FROM customer WHERE c_custkey % 10 > 0""")
def exported_companies(spark, sf_dir):
    """A company table written as CSV and read again as leads, without its banner rows."""
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS place", "CASE WHEN c_custkey % 10 = 0 THEN '═════ REVIEW' ELSE concat('Firm \"', c_custkey, '\", Inc') END AS company", "concat('a', c_custkey, '@firm.example') AS email",
        "CASE WHEN c_custkey % 2 = 0 THEN concat('+49 30 ', c_custkey) END AS phone", "c_custkey % 90 AS lead_score", "CASE WHEN c_custkey % 3 = 0 THEN 'verified' ELSE 'review' END AS match_confidence", "'One\\ntwo, \"three\"' AS company_summary", "1 AS other",
    )
    path = folder(spark, "exported-companies")
    files.write_table(files.company_table(c), path)
    back = files.read_leads(spark, path)
    if back.columns != fixed.COMPANY_COLUMNS:
        raise ValueError("the table's columns changed on their way")
    return back.select(*EXPORTED)
