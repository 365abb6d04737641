"""Companies through source pages and lead tables: edge rows, and what is read at all."""

import pytest

from tessera.operators import harvest
from tessera.sources import files, html

HREF = '<a href="{}">{}</a>'


def page(*links):
    return "".join(HREF.format(*x) for x in links)


def tables(spark, sources, pages):
    return spark.createDataFrame(sources, "source string, rank int, domain string"), spark.createDataFrame(pages, "url string, html string, source string")


def test_sources_nulls_repeats_and_missing_pages(spark):
    home = page(("https://a.io", "Alpha"), ("https://A.io/again", "Other"), ("/items/x", "More about x"), ("http://[bad", "Bad"), ("https://s.com/", "Home"))
    sources, pages = tables(
        spark,
        [("s.com", 2, "clash"), ("s.com", 1, None), (None, 3, None), ("", 4, None), ("gone.com", 5, None), ("https://t.com/", 0, None)],
        [("https://s.com/", home, "x"), ("https://s.com", home, "x"), ("https://s.com/items/x", page(("https://b.io", "View"), ("https://a.io", "Alpha")), None), ("https://s.com/items/x/", None, None), ("https://t.com", page(("https://b.io", "Beta")), None), (None, None, None)],
    )
    found = harvest.from_sources(sources, pages, 5)
    got = [tuple(r) for r in found.select("source", "place", "company", "domain").orderBy("source", "place").collect()]
    assert got == [("https://t.com/", 1, "Beta", "b.io"), ("s.com", 1, "Alpha", "a.io"), ("s.com", 2, "B", "b.io")]
    assert [(r.source, r.domain) for r in harvest.pool(found, sources, 1).collect()] == [("https://t.com/", "b.io"), ("s.com", "a.io")]
    none = harvest.from_sources(sources.limit(0), pages, 5)
    assert none.count() == 0 and harvest.pool(none, sources.limit(0), 3).count() == 0
    assert harvest.from_sources(sources, pages.limit(0), 5).count() == 0


@pytest.mark.parametrize("limit, want", [(1, ["a.io"]), (2, ["a.io", "b.io"]), (3, ["a.io", "b.io", "c.io"]), (9, ["a.io", "b.io", "c.io", "d.io"])])
def test_source_limit(spark, limit, want):
    sources, pages = tables(
        spark,
        [("https://s.com", 1, None)],
        [("https://s.com", page(("https://a.io", "A a"), ("/tools/1", "Go"), ("https://b.io", "B b"), ("/x2", "Two")), None), ("https://s.com/tools/1", page(("https://c.io", "C c"), ("https://a.io", "A")), None), ("https://s.com/x2", page(("https://d.io", "D d")), None)],
    )
    assert [r.domain for r in harvest.from_sources(sources, pages, limit).orderBy("place").collect()] == want


def test_pool_size():
    assert [harvest.pool_size(n) for n in (0, 1, 5, 50)] == [20, 21, 25, 250]


def test_detail_links_by_path_or_words(spark):
    links = [("/products/one", "View"), ("/one", "View"), ("/two", "Second firm"), ("/two?x=1", "Second again"), ("/blog/three", "Third firm"), ("/four", "4"), ("https://sub.s.com/five/", "Fifth"), ("https://other.com/six", "Sixth"), ("ftp://s.com/seven", "Seventh"), ("#top", "Up there"), ("/eight", "")]
    pages = spark.createDataFrame([(1, "https://s.com/list", page(*links)), (2, None, None), (3, "https://e.com", "")], "id int, url string, html string")
    found = html.links(pages, "id")
    got = [(r.key, r.href) for r in html.detail_links(found).orderBy("key", "pos").collect()]
    # "#top" leads to the list itself, which is a page of the site like any other
    assert got == [(1, "https://s.com/products/one"), (1, "https://s.com/two"), (1, "https://sub.s.com/five"), (1, "https://s.com/list")]
    assert html.detail_links(found, 2).count() == 2


def test_lead_tables(spark):
    rows = spark.createDataFrame([("", None, "ERROR: x", "low", 7), (None, "a@b.c", "Hi", None, 8), ("Ann", "", "ERROR: y", "", None), ("Bob", "b@b.c", None, "odd | low", 9)], "name string, email string, generated_email string, quality_warnings string, personalization_score int")
    assert sorted(tuple(r) for r in files.issues(rows).collect()) == [("", "", "7", "low | generation_failed"), ("Ann", "", "n/a", "generation_failed"), ("Bob", "b@b.c", "9", "odd | low")]
    assert {r.email for r in files.contactable(rows).collect()} == {"a@b.c", "b@b.c"} and files.sendable(rows).count() == 1
    report = lambda df, *a: files.lead_report(df, *a).first().asDict()
    assert report(rows) == {"n_rows": 4, "no_email": 2, "no_website": 4, "n_kept": 0, "has_website": False, "problem": "missing_email"}
    assert report(rows, True)["n_kept"] == 4 and report(rows.limit(0), True)["problem"] == "no_rows_left"
    sites = spark.createDataFrame([("a@b.c", " "), ("c@d.e", "x.com"), ("e@f.g", None)], "email string, website string")
    assert (report(sites)["n_kept"], report(sites, False, "keep")["n_kept"], report(sites)["no_website"]) == (1, 3, 2)
    assert files.issues(rows.limit(0)).count() == 0 and files.issues(sites).count() == 0
