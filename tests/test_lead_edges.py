"""Nulls and empty tables through the operators of discovery."""

from pyspark.sql import functions as F

from tessera.operators import judging, locations, lookups, search


def test_country_of_nulls_and_of_nothing(spark):
    names = "id int, address string, phones string, website string, summary string"
    df = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", ""), (3, None, "+", "x", "based in "), (4, None, None, "https://a.io", "customers based in France"), (5, None, None, None, "A Berlin-based firm"), (6, None, None, None, "customers based in France. A Berlin-based firm")], names)
    found = {r.id: r.country for r in locations.detected_country(df, "id", lookups.places(spark), lookups.regions(spark)).select("id", "country").collect()}
    assert found == {1: "", 2: "", 3: "", 4: "", 5: "germany", 6: "france"}  # 6: the words before "-based" are up to 29 characters, and countries come before cities
    assert locations.detected_country(df.limit(0), "id", lookups.places(spark), lookups.regions(spark)).count() == 0


def test_verdicts_of_broken_answers(spark):
    rows = judging.batches(spark.createDataFrame([("a.com", None, None), ("b.com", "B", "x\ny")], "domain string, company string, summary string"), 1)
    answers = spark.createDataFrame([(0, None), (0, "no json"), (0, '{"results":[{"i":1}]}')], "batch int, raw string")
    found = {r.domain: (r.verdict, r.verdict_evidence) for r in judging.judged(rows, answers).select("domain", "verdict", "verdict_evidence").collect()}
    assert found == {"a.com": ("unknown", ""), "b.com": ("unknown", "")}
    assert judging.prompts(rows, "T").first().prompt == 'T\n[0] name="" site=a.com summary=""\n[1] name="B" site=b.com summary="x y"'


def test_page_urls_of_nulls(spark):
    df = spark.createDataFrame([("A", "a.com", 0, 1, None), ("A", "a.com", 1, 2, "https://a.com/about/"), ("B", None, 0, 1, "https://b.com/about")], "company string, domain string, query_place int, rank int, url string")
    assert [(r.domain, r.url) for r in search.company_page_urls(df, 3).collect()] == [("a.com", "https://a.com/about")]
    assert search.company_page_urls(df.filter(F.lit(False)), 3).count() == 0
