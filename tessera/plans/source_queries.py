"""Queries of encyclopedia lists, profile titles and engines' answers, over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators import lookups, people, ranking, search
from tessera.plans import engine, metrics
from tessera.plans.catalogue import literal, query, table
from tessera.sources import engines, wiki

# --- lists: forty customers a page, each written in one of ten ways ----------------------------------------------------

PER_PAGE = 40


def wiki_lines(spark, sf_dir):
    """Pages (title, text): names in bullets, links and tables, some in sections that do not count, some no companies."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", f"floor(c_custkey / {PER_PAGE}) AS page", "c_custkey % 10 AS way", "lower(c_mktsegment) AS seg")
    line = F.expr("""CASE way WHEN 0 THEN '* [[Acme ' || k || ' Ltd|Acme ' || k || ']] – the best (est. 1990)' WHEN 1 THEN '** ''''''Firm ' || k || ''''''' <ref name=a>x</ref>, old'
      WHEN 2 THEN '{| class="wikitable"\n! Name !! Since\n|-\n| style="a" | [[Cell ' || k || ']] || 1990\n|-\n! Head ' || k || '\n|-\n|Mate ' || k || '\n|}' WHEN 3 THEN '[[Target|Link ' || k || ']] is here'
      WHEN 4 THEN '* Ministry of ' || k WHEN 5 THEN '* SAME Name' WHEN 6 THEN '== Defunct ' || seg || ' ==\n* Gone ' || k || '\n== Now ==' WHEN 7 THEN '{| open\n| Lost ' || k || '\n{|\n|-\n| Found ' || k || '\n|}'
      WHEN 8 THEN 'Plain text ' || k WHEN 9 THEN '* {{flag|x}} Firm-' || k || ' <!-- no -->' END""")
    each = c.select("page", "k", line.alias("line"))
    return each.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text")).select(F.concat(F.lit("List of makers "), F.col("page")).alias("title"), "text")


LISTED = f"""
c AS (SELECT c_custkey AS k, c_custkey // {PER_PAGE} AS page, c_custkey % 10 AS way FROM customer),
n AS (SELECT page, k, 0 AS i, CASE way WHEN 0 THEN 'Acme ' || k WHEN 1 THEN 'Firm ' || k || ' , old' WHEN 2 THEN 'Cell ' || k WHEN 3 THEN 'Link ' || k || ' is here' WHEN 5 THEN 'SAME Name' WHEN 7 THEN 'Found ' || k WHEN 9 THEN 'Firm-' || k END AS name FROM c
      UNION ALL SELECT page, k, 1, 'Mate ' || k FROM c WHERE way = 2),
listed AS (SELECT page, name, row_number() OVER (PARTITION BY page ORDER BY k, i) - 1 AS pos FROM (SELECT * FROM n WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page, lower(name) ORDER BY k, i) = 1))"""


@query(f"WITH {LISTED} SELECT 'List of makers ' || page AS key, pos::INTEGER AS pos, name FROM listed WHERE pos < 20")
def listed_names(spark, sf_dir):
    return wiki.names(wiki_lines(spark, sf_dir), "title", "text", 20)


# --- from profiles to names: two lists and a category for each page ---------------------------------------------------------


@query(rf"""
WITH {LISTED},
p AS (SELECT DISTINCT page, CASE page % 4 WHEN 0 THEN 'Timber makers' WHEN 1 THEN 'timber company' WHEN 2 THEN 'steel' ELSE 'timber' END AS phrase, CASE WHEN page % 7 = 6 THEN '' ELSE 'Land ' || page END AS region FROM c),
t AS (SELECT page AS profile, 1 AS turn, page AS of FROM p WHERE region <> '' AND page % 4 <> 2 AND page % 3 <> 0
      UNION ALL SELECT page, 2, (page + 1) % (SELECT count(*) FROM p) FROM p WHERE region <> '' AND page % 4 <> 2 AND page % 3 <> 0),
l AS (SELECT t.profile, turn, pos, name, 'https://en.wikipedia.org/wiki/List_of_timber_makers_' || t.of || '_of_Land_' || t.profile || '%3F' AS source FROM t JOIN listed ON listed.page = t.of WHERE pos < 25),
m AS (SELECT page AS profile, 9 AS turn, i AS pos, 'Member ' || i || ' of ' || page AS name, 'https://en.wikipedia.org/wiki/Category%3A' || upper(left(trim(replace(phrase, 'company', '')), 1)) || replace(substr(trim(replace(phrase, 'company', '')), 2), ' ', '_') || '_companies_in_' || replace(region, ' ', '_') AS source
      FROM p, range(1, 4) r(i) WHERE region <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY turn, pos) AS seat FROM (SELECT * FROM (SELECT * FROM l UNION ALL SELECT * FROM m) QUALIFY row_number() OVER (PARTITION BY profile, lower(name) ORDER BY turn, pos) = 1))
SELECT profile::BIGINT AS profile, seat::INTEGER AS pos, name, source FROM o WHERE seat <= 25""")
def encyclopedia_names(spark, sf_dir):
    lists = wiki_lines(spark, sf_dir).withColumn("page", F.expr("cast(substring_index(title, ' ', -1) AS bigint)"))
    pages = lists.select("page", F.expr("CASE page % 4 WHEN 0 THEN 'Timber makers' WHEN 1 THEN 'timber company' WHEN 2 THEN 'steel' ELSE 'timber' END").alias("phrase"), F.expr("CASE WHEN page % 7 = 6 THEN '' ELSE 'Land ' || page END").alias("region"))
    term = F.when(F.col("phrase") == "steel", "steel").otherwise("timbers")
    profiles = pages.select(F.col("page").alias("profile"), "phrase", F.array(term).alias("terms"), "region", F.lit("").alias("region_key"))
    n = pages.count()
    # the first query of every third page finds nothing that suits; the second is not asked where the first has something
    hits = pages.selectExpr("page AS profile", "region", f"array(page, (page + 1) % {n}) AS of").select("profile", "region", F.posexplode("of").alias("rank", "of"))
    good = F.concat(F.lit("List of timber makers "), F.col("of"), F.lit(" of "), F.col("region"), F.lit("?"))
    hits = hits.withColumn("title", F.when(F.col("profile") % 3 != 0, good).otherwise(F.concat(F.lit("List of airlines of "), F.col("region"))))
    hits = hits.select("profile", F.lit(0).alias("query_place"), "rank", "title").union(hits.selectExpr("profile", "1", "rank", "'Timber makers of ' || region"))
    texts = hits.filter("query_place = 0").select("title", F.expr("cast(regexp_extract(title, 'makers ([0-9]+)', 1) AS string)").alias("of")).join(lists.select(F.col("page").cast("string").alias("of"), "text"), "of").select("title", "text")
    named = F.expr("regexp_replace(phrase, ' ?company$', '')")
    category = F.concat(F.lit("Category:"), F.upper(F.substring(named, 1, 1)), F.expr("substring(regexp_replace(phrase, ' ?company$', ''), 2)"), F.lit(" companies in "), F.col("region"))
    members = pages.select(category.alias("category"), "page", F.explode(F.array(*map(F.lit, range(5)))).alias("rank"))
    members = members.select("category", "rank", F.expr("CASE WHEN rank = 0 THEN 'Category:Other' WHEN rank = 4 THEN 'Institute ' || page ELSE 'Member ' || rank || ' of ' || page END").alias("title"))
    return wiki.company_names(profiles, hits, texts, members, 25)


# --- persons who are only called like the company ---------------------------------------------------------------------------

PEOPLE_SQL = """CASE k % 12 WHEN 0 THEN 'anncrisp' || k WHEN 1 THEN 'ann-crisp-' || lower(hex(k + 65536)) WHEN 2 THEN 'ann-at-crisp' WHEN 3 THEN 'label' || k WHEN 4 THEN 'acrisp' WHEN 5 THEN 'crisp_ann' WHEN 6 THEN 'annc' WHEN 7 THEN 'crispworks' WHEN 8 THEN 'someone-else-entirely' WHEN 9 THEN 'ann-mid-crisp' WHEN 10 THEN 'annmidcrisp-' || (k + 1000) ELSE 'crisp-team-lead' END"""


@query(f"""
WITH c AS (SELECT c_custkey AS k, c_custkey // 12 % 4 AS who FROM customer),
r AS (SELECT k, who, {PEOPLE_SQL} AS slug, k % 12 AS way FROM c)
SELECT k AS id, CASE who WHEN 0 THEN way IN (0, 1, 3, 4, 6, 8) WHEN 1 THEN way IN (0, 1, 3, 4, 6, 8, 9, 10) ELSE false END AS coincidence,
  CASE who WHEN 0 THEN 'Crisp' WHEN 1 THEN '' WHEN 2 THEN 'Crisp Works' ELSE '' END AS said, who IN (0, 1, 2) AS in_title FROM r""")
def name_coincidence(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "floor(c_custkey / 12) % 4 AS who").withColumn("slug", F.expr(PEOPLE_SQL))
    name = F.expr("CASE who WHEN 1 THEN 'Ann Mid Crisp' WHEN 3 THEN 'Crisp' ELSE 'Ann Crisp' END")
    company = F.expr("CASE who WHEN 2 THEN 'Works GmbH' ELSE 'Crisp' END")
    title = F.expr("CASE who WHEN 0 THEN 'Ann Crisp - Head of Sales - Crisp | LinkedIn' WHEN 1 THEN 'Ann Mid Crisp - Manager at Crisp | LinkedIn' WHEN 2 THEN 'x - Crisp Works | LinkedIn' ELSE 'Other | Elsewhere' END")
    url = F.concat(F.lit("https://www.linkedin.com/in/"), F.col("slug"), F.lit("/"))
    return c.select(F.col("k").alias("id"), people.named_like_company(name, company, url).alias("coincidence"), people.company_of_title(title).alias("said"), people.company_in_title(title, company).alias("in_title"))


# --- answers of five engines --------------------------------------------------------------------------------------------------

ANSWERS = {
    "serper": """'{"organic": [{"title": "A' || k || '", "link": "https://a' || k || '.com", "snippet": "s", "position": 1}, {"link": "https://b.com"}], "credits": 1}'""",
    "ddgs": """'[{"title": "T", "href": "https://d' || k || '.org/x", "body": "b"}]'""",
    "searxng": """'{"results": [{"url": "https://s' || k || '.net", "title": "S", "content": "c", "publishedDate": "2024-01-0' || (k % 9) || '", "engines": ["g", "b"]}, {"title": "no url"}, {"url": "https://t.net", "engines": []}]}'""",
    "mojeek": """'<ul><li class="result r1"><a href="https://m' || k || '.com/c">Cache</a><h2><a class="ob" href="https://m' || k || '.com/">M <b>' || k || '</b></a></h2><p class="s">Says <em>it</em>.</p><span class="date">May</span></li><li class="result"><a href="https://www.mojeek.com/x">own</a></li><li class="other"><a href="https://no.com">no</a></li><li class="result"><a href="https://n.com">N</a></li></ul>'""",
    "brave": """'<a href="https://search.brave.com/x">Brave own link</a><a href="https://b' || k || '.com/one">b.com › one The title ' || k || '</a><a href="https://b' || k || '.com/one">b.com › one again and again</a><a href="/rel">a relative link</a><a href="https://c.com/">short</a><a href="https://c.com/">c.com long enough</a>'""",
    "broken": """'{"organic": [{"title": "A"'""",
}
ANSWER_SQL = "CASE k % 7 " + " ".join(f"WHEN {i} THEN {raw}" for i, raw in enumerate(ANSWERS.values())) + " END"
ENGINE_SQL = "CASE k % 7 " + " ".join(f"WHEN {i} THEN '{name if name != 'broken' else 'serper'}'" for i, name in enumerate(ANSWERS)) + " ELSE 'mojeek' END"


@query(f"""
WITH c AS (SELECT c_custkey AS k FROM customer),
r AS (
  SELECT k, 1 AS rank, 'A' || k AS title, 'https://a' || k || '.com' AS url, 's' AS snippet, '' AS published, 'serper' AS engine FROM c WHERE k % 7 = 0
  UNION ALL SELECT k, 2, '', 'https://b.com', '', '', 'serper' FROM c WHERE k % 7 = 0
  UNION ALL SELECT k, 1, 'T', 'https://d' || k || '.org/x', 'b', '', 'ddgs' FROM c WHERE k % 7 = 1
  UNION ALL SELECT k, 1, 'S', 'https://s' || k || '.net', 'c', '2024-01-0' || (k % 9), 'searxng(g, b)' FROM c WHERE k % 7 = 2
  UNION ALL SELECT k, 2, '', 'https://t.net', '', '', 'searxng' FROM c WHERE k % 7 = 2
  UNION ALL SELECT k, 1, 'M ' || k, 'https://m' || k || '.com/', 'Says it .', 'May', 'mojeek' FROM c WHERE k % 7 = 3
  UNION ALL SELECT k, 2, 'N', 'https://n.com', '', '', 'mojeek' FROM c WHERE k % 7 = 3
  UNION ALL SELECT k, 1, 'The title ' || k, 'https://b' || k || '.com/one', '', '', 'brave' FROM c WHERE k % 7 = 4
  UNION ALL SELECT k, 2, 'c.com long enough', 'https://c.com/', '', '', 'brave' FROM c WHERE k % 7 = 4)
SELECT k AS key, rank::INTEGER AS rank, title, url, snippet, published, engine FROM r""")
def engine_answers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k")
    return engines.read_answers(c.select(F.col("k").alias("key"), F.expr(ENGINE_SQL).alias("engine"), F.expr(ANSWER_SQL).alias("raw")))


# --- figures of a run ---------------------------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT c_custkey AS k, c_custkey % 7 = 0 AS failed FROM customer)
SELECT count(*) AS n_rows, count(*) FILTER (NOT failed) AS n_written, count(*) FILTER (failed) AS n_warned FROM d""")
def run_figures(spark, sf_dir):
    """The figures of a draft run, read after its one action."""
    leads = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name AS name")
    answers = leads.filter("k % 7 <> 0").selectExpr("k", "'Subject: Hello ' || k || '\n\nDear ' || name || ', a line that says something.' AS raw")
    run = metrics.Run()
    drafts = run.watch(engine.draft(leads, answers, "k"), "drafts", **metrics.figures("drafts"), n_warned=F.count_if(F.contains(F.col("quality_warnings"), F.lit("generation_failed"))))
    drafts.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(run.of("drafts").values())], "n_rows bigint, n_written bigint, n_warned bigint")


# --- queries for regions and languages, and their order -------------------------------------------------------------------------

TEMPLATES_SQL = ", ".join("replace(replace('" + t + "', '{icp}', phrase), '{region}', region)" for t in fixed.REGION_TEMPLATES)
PHRASE_SQL = "CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN lower(c_mktsegment) || ' and wood makers' ELSE 'paper mills for ' || lower(c_mktsegment) END"


@query(f"""
WITH p AS (SELECT DISTINCT {PHRASE_SQL} AS phrase, 'Land ' || c_nationkey AS region FROM customer),
q AS (SELECT phrase, region, [{TEMPLATES_SQL}] || CASE WHEN contains(phrase, ' and ') THEN ['"' || replace(phrase, ' and ', ' ') || '" ' || region] WHEN contains(phrase, ' for ') THEN ['"paper mills" ' || region] ELSE [] END AS l FROM p)
SELECT phrase, region, (unnest(range(len(l))))::INTEGER AS place, unnest(l) AS query FROM q""")
def queries_by_region(spark, sf_dir):
    return search.region_queries(table(spark, sf_dir, "customer").selectExpr(f"{PHRASE_SQL} AS phrase", "'Land ' || c_nationkey AS region"))


LANGS = [(r[0], i, lang) for r in lookups.region_rows() for i, lang in enumerate(r[3][:2])]


@query(f"""WITH l AS (SELECT lang FROM {literal(LANGS, "region_key, i, lang")} WHERE region_key = 'switzerland') SELECT DISTINCT p_name AS term, lang FROM part, l""")
def terms_by_language(spark, sf_dir):
    return lookups.language_terms(table(spark, sf_dir, "part").select(F.col("p_name").alias("term")), lookups.regions(spark), "switzerland", 2)


@query("""
WITH t AS (SELECT source, doc_id, left(text, 12) AS said, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY said ORDER BY turn, source) = 1)
SELECT row_number() OVER (ORDER BY turn, source)::INTEGER AS place, said AS text FROM f""")
def interleaved_sources(spark, sf_dir):
    """A lane for each source of the documents, one of which has most of them."""
    return ranking.interleave(table(spark, sf_dir, "documents").select("source", "doc_id", F.substring("text", 1, 12).alias("text")), "text", "source", "doc_id")
