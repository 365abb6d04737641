"""Queries of crawling and matching over the driver's tables: refill, failure memory, site texts, lexicon, geography, translation on a miss."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators import cooldown, expansion, lexicon, lookups, refill, translation
from tessera.plans.catalogue import CUT, PLACES, STEM, inside, literal, query, table
from tessera.sources import html, maintext

# --- refill: the first hosts whose page has a long title -------------------------------------------------------------

LIMIT, LONG_TITLE = 20, 60
TITLE = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&', 'g'), '\s+', ' ', 'g'))"


@query(rf"""
WITH RECURSIVE p AS (SELECT page_id, length(url) AS n, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, {TITLE} AS title FROM pages),
c AS (SELECT *, row_number() OVER (ORDER BY n, page_id, host) AS place FROM (SELECT * FROM p WHERE host <> '' QUALIFY row_number() OVER (PARTITION BY host ORDER BY n, page_id) = 1)),
t AS (SELECT *, length(title) >= {LONG_TITLE} AS passes FROM c),
x AS (SELECT place, sum(passes::INT) OVER (ORDER BY place) AS passed, count(*) OVER () AS total FROM t),
r(tested, passed, total) AS (
  SELECT 0::BIGINT, 0::HUGEINT, (SELECT count(*) FROM t)
  UNION ALL
  SELECT x.place, x.passed, r.total FROM r JOIN x ON x.place = least(r.tested + CASE WHEN r.tested = 0 THEN {LIMIT} ELSE greatest({LIMIT} - r.passed, 2) END, r.total)
  WHERE r.passed < {LIMIT} AND r.tested < r.total)
SELECT place, page_id, host, title FROM t WHERE passes AND place <= (SELECT max(tested) FROM r)""")
def refill_hosts(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    pages = table(spark, sf_dir, "pages").select("page_id", F.length("url").alias("n"), host.alias("host"), "html")
    titled = lambda part: html.parse_pages(part, ["place", "page_id", "host"]).filter(F.length("title") >= LONG_TITLE)
    found = refill.refill(pages, "host", [F.col("n"), F.col("page_id")], titled, LIMIT)
    return found.rows.select("place", "page_id", "host", "title")


# --- failure memory over the events: three instances, errors are failures ----------------------------------------------

MICROS = int(cooldown.SECONDS * 1_000_000)


@query(f"""
WITH RECURSIVE a AS (SELECT event_id, user_id % 3 AS instance, epoch_us(ts) AS us, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT instance, n, CASE WHEN ok THEN n + 1 ELSE 1 + count(*) OVER (PARTITION BY instance ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {MICROS - 1} FOLLOWING) END AS after FROM a),
c(instance, n) AS (SELECT DISTINCT instance, 1::BIGINT FROM a UNION ALL SELECT f.instance, f.after FROM c JOIN f ON f.instance = c.instance AND f.n = c.n),
s AS (SELECT a.*, c.n IS NOT NULL AS made FROM a LEFT JOIN c ON c.instance = a.instance AND c.n = a.n)
SELECT event_id, instance, made, CASE WHEN made AND ok THEN NULL ELSE last_value(CASE WHEN made THEN us + {MICROS} END IGNORE NULLS) OVER (PARTITION BY instance ORDER BY n) END AS until FROM s""")
def instance_cooldown(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 3 AS instance", "ts", "event_type <> 'error' AS ok")
    made = cooldown.attempted(events, "event_id", "instance", "ts", "ok")
    return made.select("event_id", "instance", "made", F.unix_micros("until").alias("until"))


# --- texts of sites: two pages each, the second as /about --------------------------------------------------------------


@query()
def site_texts(spark, sf_dir):
    site = F.concat(F.lit("s"), F.floor(F.col("page_id") / 2).cast("string"), F.lit(".example"))
    url = F.concat(F.lit("https://"), site, F.when(F.col("page_id") % 2 == 1, "/about").otherwise(""))
    pages = table(spark, sf_dir, "pages").select(site.alias("site"), url.alias("url"), "html")
    return maintext.crawl(pages.select("site", F.col("site").alias("url")).distinct(), pages.select("url", "html"))


@query()
def page_main_texts(spark, sf_dir):
    """Every third page without its article, every third with a role instead, so that all ways to a page's text are taken."""
    kind = F.when(F.col("page_id") % 3 == 1, "div").when(F.col("page_id") % 3 == 2, 'div role="main"')
    changed = F.regexp_replace(F.regexp_replace("html", F.lit("<article>"), F.concat(F.lit("<"), kind, F.lit(">"))), F.lit("</article>"), F.lit("</div>"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce(changed, "html").alias("html"))
    return maintext.page_texts(pages, ["page_id"])


# --- lexicon: clusters of documents, overrides and profiles of conversations -------------------------------------------

WORD = "[a-z]{6,}"


@query(rf"""
WITH d AS (SELECT 'doc/' || doc_id AS cluster_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
v AS (SELECT conv_id * 100 + turn AS profile, regexp_extract_all(lower(text), '{WORD}') AS w FROM conversations),
u AS (SELECT 'user/' || profile || '/0' AS cluster_id, w FROM v WHERE len(w) >= 3 AND profile % 5 <> 4),
lex AS (SELECT DISTINCT cluster_id, lower(trim(term)) AS term FROM (
  SELECT cluster_id, unnest([w[1], w[2] || ' ' || w[3], w[4]]) AS term FROM d
  UNION ALL SELECT cluster_id, unnest([w[1], w[2], w[1] || ' ' || w[3]]) FROM u) t WHERE trim(coalesce(term, '')) <> ''),
p AS (SELECT profile, w[1 : 4] AS w, upper(array_to_string(w[1 : 4], ' ')) || 's' AS phrase FROM v WHERE len(w) > 0),
tok AS (SELECT DISTINCT profile, token, {STEM.format(x=CUT.replace('(w)', '(token)'))} AS stem FROM (SELECT profile, unnest(w) AS token FROM p) q),
k AS (SELECT DISTINCT term, string_split(term, ' ') AS w FROM lex),
one AS (SELECT profile, token, term FROM (SELECT term, {STEM.format(x=CUT.replace('(w)', '(term)'))} AS stem FROM k WHERE len(w) = 1) q JOIN tok USING (stem)),
held AS (SELECT DISTINCT profile, term, k.w FROM p JOIN k ON len(k.w) > 1 AND contains(lower(p.phrase), k.term)),
st AS (SELECT DISTINCT profile, term, {STEM.format(x=CUT.replace('(w)', '(x)'))} AS stem FROM (SELECT profile, term, unnest(w) AS x FROM held) q),
more AS (SELECT st.profile, st.term, tok.token FROM st JOIN tok ON tok.profile = st.profile AND tok.stem = st.stem),
asked AS (SELECT profile, token, term FROM one UNION SELECT profile, token, term FROM more UNION SELECT profile, NULL, term FROM held WHERE (profile, term) NOT IN (SELECT (profile, term) FROM more))
SELECT DISTINCT a.profile, a.token, y.term FROM asked a JOIN lex x ON x.term = a.term JOIN lex y ON y.cluster_id = x.cluster_id AND y.term <> a.term""")
def merged_lexicon(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), 1)
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("cluster_id"), words.alias("w"))
    built_in = docs.select("cluster_id", F.explode(F.array(F.get("w", F.lit(0)), F.concat(F.get("w", F.lit(1)), F.lit(" "), F.get("w", F.lit(2))), F.get("w", F.lit(3)))).alias("term"))
    talks = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("profile"), words.alias("w"))
    three = talks.filter("size(w) >= 3")
    # a user's file for each turn: one list with a blank term, and an entry that is no list; every fifth is broken
    raw = F.format_string('{"%s": ["%s", " ", "%s %s"], "n": 5%s', *(F.get("w", F.lit(i)) for i in (0, 1, 0, 2)), F.when(F.col("profile") % 5 != 4, "}").otherwise(""))
    own = lexicon.cluster_rows(three.select("profile", raw.alias("raw")), "profile", "raw")
    profiles = talks.filter("size(w) > 0").select("profile", F.slice("w", 1, 4).alias("tokens")).withColumn("phrase", F.concat(F.upper(F.array_join("tokens", " ")), F.lit("s")))
    return lexicon.spoken_for(profiles, lexicon.merged(built_in, own))


# --- geography never stands for an industry --------------------------------------------------------------------------

NAMES = [(r[0].replace("_", " "),) for r in lookups.region_rows()]
FORMS = [f"w || '{e}'" for e in lexicon.ENDINGS + lexicon.SWALLOWING] + [f"regexp_replace(w, '[aeiouy]+$', '') || '{e}'" for e in lexicon.SWALLOWING]
TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"
TERMS_SQL = f"""
names AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS k FROM {literal(NAMES, "name")}),
terms AS (SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN name WHEN 1 THEN name || 'n' WHEN 2 THEN name || ' nuts' WHEN 3 THEN lower(c_mktsegment) || ' maker' WHEN 4 THEN 'ab' WHEN 5 THEN 'solutions'
  WHEN 6 THEN 'wood and paper mill' WHEN 7 THEN regexp_replace(name, '[aeiouy]+$', '') || 'ian' ELSE lower(c_mktsegment) || 's' END AS term FROM customer JOIN names ON (c_custkey // 9) % {len(NAMES)} = k)"""


@query(f"""
WITH {TERMS_SQL}, pl AS (SELECT {TOKENS.format(x='token')} AS v, kind FROM {literal(PLACES, "token, region_key, kind")} UNION ALL SELECT string_split(replace(t, '_', ' '), ' '), 2 FROM {literal([(c,) for c in lexicon.CAPITALS.split()], "t")}),
last AS (SELECT v[1 : len(v) - 1] AS b, v[-1] AS w FROM pl WHERE kind < 2),
geo AS (SELECT array_to_string(v, ' ') AS run FROM pl UNION SELECT array_to_string(list_append(b, f), ' ') FROM (SELECT b, unnest([{', '.join(FORMS)}]) AS f FROM last) q),
good AS (SELECT id, term, {TOKENS.format(x='term')} AS v FROM terms WHERE length(term) >= 3 AND len(string_split(term, ' ')) <= 3 AND regexp_matches(term, '^[a-z][a-z -]+$') AND term NOT IN {inside(fixed.GENERIC_TERMS + lexicon.SAY_NOTHING)})
SELECT id, term, NOT EXISTS (SELECT 1 FROM geo WHERE run IN (SELECT array_to_string(good.v[i : j], ' ') FROM range(1, 4) a(i), range(1, 4) b(j) WHERE i <= j AND j <= len(good.v))) AS nowhere
FROM good WHERE array_to_string(v, ' ') NOT IN (SELECT run FROM geo)""")
def industry_terms(spark, sf_dir):
    names = spark.createDataFrame([(n, i) for i, n in enumerate(sorted(n for (n,) in NAMES))], "name string, k int")
    customers = table(spark, sf_dir, "customer").join(F.broadcast(names), F.expr(f"floor(c_custkey / 9) % {len(NAMES)} = k"))
    terms = customers.selectExpr("c_custkey AS id", "CASE c_custkey % 9 WHEN 0 THEN name WHEN 1 THEN name || 'n' WHEN 2 THEN name || ' nuts' WHEN 3 THEN lower(c_mktsegment) || ' maker' WHEN 4 THEN 'ab' WHEN 5 THEN 'solutions' WHEN 6 THEN 'wood and paper mill' WHEN 7 THEN regexp_replace(name, '[aeiouy]+$', '') || 'ian' ELSE lower(c_mktsegment) || 's' END AS term")
    geo = lexicon.geography(lookups.places(spark))
    good = lexicon.good_terms(terms, geo)
    nowhere = lexicon.good_terms(terms.select("term").distinct(), geo, anywhere=True).withColumn("nowhere", F.lit(True))
    return good.join(nowhere, "term", "left").select("id", "term", F.coalesce("nowhere", F.lit(False)).alias("nowhere"))


# --- translation on a miss -------------------------------------------------------------------------------------------


@query(r"""
WITH c AS (SELECT conv_id * 100 + turn AS id, string_split(text, chr(10)) AS l FROM conversations),
r AS (SELECT id, l[1] AS summary, array_to_string(l, ' | ') AS facts FROM c),
e AS (SELECT *, contains(lower(summary || ' ' || facts), 'tion') AS evidenced FROM r),
tr AS (SELECT t AS text, CASE WHEN length(t) % 3 = 0 THEN ' station ' || left(t, 10) WHEN length(t) % 3 = 1 THEN ' ' ELSE 'x' || right(t, 5) END AS result
       FROM (SELECT DISTINCT unnest(l) AS t FROM c) q WHERE length(t) % 4 <> 0),
ok AS (SELECT text, trim(result) AS result FROM tr WHERE trim(result) <> ''),
f AS (SELECT e.id, string_agg(coalesce(ok.result, p.t), ' | ' ORDER BY p.n) AS facts FROM e, LATERAL (SELECT unnest(string_split(e.facts, ' | ')) AS t, generate_subscripts(string_split(e.facts, ' | '), 1) AS n) p LEFT JOIN ok ON ok.text = p.t WHERE NOT evidenced GROUP BY e.id),
o AS (SELECT e.id, CASE WHEN evidenced THEN e.summary ELSE coalesce(ok.result, e.summary) END AS summary, coalesce(f.facts, e.facts) AS facts, NOT evidenced AND e.facts <> '' AS localized FROM e LEFT JOIN f ON f.id = e.id LEFT JOIN ok ON ok.text = e.summary)
SELECT id, md5(summary) AS summary_md5, md5(facts) AS facts_md5, localized, contains(lower(summary || ' ' || facts), 'tion') AS confirmed FROM o""")
def localized_facts(spark, sf_dir):
    lines = F.split("text", "\n")
    talks = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), lines.alias("l"))
    rows = talks.select("id", F.get("l", F.lit(0)).alias("summary"), F.array_join("l", " | ").alias("facts"))
    said = talks.select(F.explode("l").alias("text")).distinct().filter("length(text) % 4 <> 0")
    said = said.selectExpr("text", "'auto' AS src", "'en' AS tgt", "CASE WHEN length(text) % 3 = 0 THEN ' station ' || left(text, 10) WHEN length(text) % 3 = 1 THEN ' ' ELSE 'x' || right(text, 5) END AS result")
    other = said.withColumns({"src": F.lit("fr"), "result": F.lit("never")})
    shown = F.contains(F.lower(F.concat_ws(" ", "summary", "facts")), F.lit("tion"))
    found = translation.localize(rows, shown, said.union(other), ["facts"], ["summary"])
    return found.select("id", F.md5("summary").alias("summary_md5"), F.md5("facts").alias("facts_md5"), "localized", shown.alias("confirmed"))


# --- related terms of profiles, from lexicon, model and answers ----------------------------------------------------------

TERM = "[a-z]{5,}"


@query(rf"""
WITH v AS (SELECT conv_id * 100 + turn AS profile, regexp_extract_all(lower(text), '{TERM}') AS w FROM conversations),
p AS (SELECT profile, w[1 : 3] AS tokens, w[1] || ' ' || w[2] AS chunk FROM v WHERE len(w) >= 3),
o AS (SELECT DISTINCT profile, unnest(tokens) AS token FROM p),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{TERM}') AS w FROM documents),
r AS (SELECT min(doc_id) AS doc_id, w[1] AS term FROM d WHERE len(w) >= 8 GROUP BY w[1]),
e AS (SELECT r.term, d.w, unnest(['ml', 'rel_trg']) AS rel FROM r JOIN d USING (doc_id)),
x AS (SELECT term, rel, i - 2 AS pos, w[CASE rel WHEN 'ml' THEN i ELSE 10 - i END] AS word FROM e, range(2, 9) t(i) WHERE i <> 4),
rel AS (SELECT * FROM x WHERE word IS NOT NULL AND word NOT IN {inside(fixed.GENERIC_TERMS + lexicon.SAY_NOTHING)} QUALIFY row_number() OVER (PARTITION BY term, rel, word ORDER BY pos) = 1),
lex AS (SELECT profile, t.token, t.token || ' works' AS term FROM o t WHERE length(token) % 2 = 0),
mdl AS (SELECT profile, 'model ' || tokens[1] AS term FROM p),
every AS (
  SELECT profile, term, 0 AS source, term AS a, 0 AS c FROM lex UNION ALL SELECT profile, term, 1, term, 0 FROM mdl
  UNION ALL SELECT o.profile, word, CASE rel.rel WHEN 'ml' THEN 2 ELSE 4 END, o.token, pos FROM o JOIN rel ON rel.term = o.token),
f AS (SELECT * FROM every WHERE (profile, term) NOT IN (SELECT (profile, token) FROM o) QUALIFY row_number() OVER (PARTITION BY profile, term ORDER BY source, a, c) = 1),
s AS (SELECT profile, term, token FROM lex UNION SELECT o.profile, word, o.token FROM o JOIN rel ON rel.term = o.token AND rel.rel = 'ml'),
k AS (SELECT profile, term, string_agg(DISTINCT token, ',' ORDER BY token) AS tokens FROM s GROUP BY ALL)
SELECT f.profile, row_number() OVER (PARTITION BY f.profile ORDER BY source, a, c, f.term)::INTEGER AS place, f.term, source, coalesce(k.tokens, '') AS tokens FROM f LEFT JOIN k ON k.profile = f.profile AND k.term = f.term QUALIFY place <= 6""")
def grouped_expansion(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({TERM})"), 1)
    profiles = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("profile"), words.alias("w")).filter("size(w) >= 3")
    profiles = profiles.select("profile", F.slice("w", 1, 3).alias("tokens"), F.array(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)))).alias("chunks"))
    own = profiles.select("profile", F.explode("tokens").alias("token")).distinct()
    spoken = own.filter("length(token) % 2 = 0").select("profile", "token", F.concat("token", F.lit(" works")).alias("term"))
    model = profiles.select("profile", F.concat(F.lit("Model "), F.get("tokens", F.lit(0))).alias("term"))
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).filter("size(w) >= 8")
    first = docs.groupBy(F.get("w", F.lit(0)).alias("term")).agg(F.min_by("w", "doc_id").alias("w"))
    # each answer names seven words, of which the third is everyday language, and ends with what is no word
    item = lambda n, i: F.concat(F.lit('{"word": "'), F.get("w", n), F.lit('", "tags": ["f:x", "f:'), F.lit("99.5" if i == 2 else "1.5"), F.lit('"]}'))
    listed = lambda order: F.concat(F.lit("["), F.concat_ws(", ", *(item(F.lit(n), i) for i, n in enumerate(order))), F.lit(', {"word": "x1"}, 5]'))
    answers = first.select("term", F.lit("ml").alias("rel"), listed(range(1, 8)).alias("raw")).union(first.select("term", F.lit("rel_trg"), listed(range(7, 0, -1))))
    found = expansion.grouped(profiles, spoken, model, expansion.related_words(answers, lexicon.geography(lookups.places(spark))), 6)
    return found.select("profile", "place", "term", "source", F.array_join("tokens", ",").alias("tokens"))
