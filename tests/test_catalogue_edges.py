"""Queries of the catalogue on rows that the smallest tables lack, held against their SQL."""

import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions import fixed, urls
from tessera.operators import lexicon, search
from tessera.plans import engine


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL, over tables (columns, rows) written to a folder."""
    con = duckdb.connect()
    for t, (columns, rows) in tables.items():
        spark.createDataFrame(rows, columns).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    return sorted(map(tuple, df.select(*columns).collect()), key=repr), sorted(want.fetchall(), key=repr)


def test_page_titles_resolve_amp_alone(spark, tmp_path):
    titles = ["token = &quot;0cf&quot;", "cut and&amp", "&&& &lt;b&gt; &#233; &eacute &nbsp;x", "A &amp; B", "&amp;quot; &amp;amp;", " a \n b "]
    pages = [(i, f"https://a.example/{i}", f"<html><head><title>{t}</title></head><body><p>x &quot;</p></body></html>") for i, t in enumerate(titles)]
    got, want = both(spark, tmp_path, "page_titles", pages=("page_id long, url string, html string", pages))
    assert got == want


def test_contact_pages_are_never_broadcast(spark):
    # sites and pages are small as tables, and several times as large with a row for each path
    sites = spark.range(50).selectExpr("concat('https://s', id, '.com') AS site")
    pages = sites.selectExpr("concat(site, '/contact/') AS url", "'<main><p>Write to us.</p></main>' AS html")
    found = engine.contact_pages(sites, pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert found.count() == 50


def test_a_site_is_judged_once_a_row(spark):
    results = spark.createDataFrame([("Firm 1", 0, 1, "https://www.firm1.co.uk/x")], "company string, query_place int, rank int, url string")
    plan = search.resolve_websites(results, require_match=True, country="uk")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?m)^\W*Window ", plan)) == 1
    assert plan.count("regexp_extract(") < 10  # each is the url cut anew; inside a lambda, for each blocked domain


def test_domains_and_hosts_below_others(spark):
    hosts = ["x.com", "a.x.com", "ax.com", "x.com.", "x.com\n", "", "g2.com", "a.b.google.com", "google.com.evil.io", "blog.a.io", "BLOG.a.io", "therapi.de", "bxdocs.y", None]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = df.select("host", urls.below(F.col("host"), fixed.BLOCKED_DOMAINS).alias("b"), urls.blocked_host(F.col("host")).alias("h")).collect()
    for r in got:
        assert r.b == (None if r.host is None else any(r.host == d or r.host.endswith("." + d) for d in fixed.BLOCKED_DOMAINS)), r
        assert r.h == (None if r.host is None else any(p in r.host.lower() for p in fixed.BLOCKED_HOST_PARTS)), r


def test_lexicon_finds_what_phrases_hold_without_a_broadcast(spark, tmp_path):
    phrases = ["red wood  floor", "", "wood", " cared woods ", "a b c d e f", "old redwood flooring", "b a b a", None]
    terms = ["ed wo", "wood  floor", "red wood", "b c", "b c d e f", "a b c d e f", "wood f", "d woods", "a b", "redwood", "od flo", "x y"]
    lexicon_ = spark.createDataFrame([(str(i), t) for i, t in enumerate(terms)] + [(str(i), f"other{i}") for i in range(len(terms))], "cluster_id string, term string")
    profiles = spark.createDataFrame([(i, p, ["red"] if p and "red" in p.split() else []) for i, p in enumerate(phrases)], "profile int, phrase string, tokens array<string>")
    stored = [(df.write.parquet(f"{tmp_path}/{n}"), spark.read.parquet(f"{tmp_path}/{n}"))[1] for n, df in (("p", profiles), ("l", lexicon_))]  # Spark knows their size
    found = lexicon.spoken_for(*stored, 5)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(i, f"other{k}") for i, p in enumerate(phrases) for k, t in enumerate(terms) if p and " " in t and t in p and len(t.split(" ")) <= 5}
    rows = found.collect()
    assert {(r.profile, r.term) for r in rows} == want and len(rows) == len(want)
    assert {r.term for r in rows if r.token == "red"} == {"other2"}
