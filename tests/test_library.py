import pytest
from pyspark.sql import functions as F

from tessera.functions import contacts, drafts, icp, scores, text, urls
from tessera.operators import lookups
from tessera.plans import engine
from tessera.sources import files, html
from tessera.streaming import intake


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_profiles():
    p = icp.parse("Health and Safety consultants of Industrial Pumps for small startups in Europe")
    assert p.phrases == [("health", "safety", "consultants"), ("industrial", "pumps")]
    assert p.tokens("core") == ["health", "safety", "consultants", "industrial", "pumps"] and p.tokens("qualifier") == ["small", "europe"]
    assert icp.parse("").chunks == () and icp.parse("software companies").phrases == []


@pytest.mark.parametrize("said, hit", [("paper and pulp mills", True), ("paper one two mill", True), ("paper one two three mill", False), ("papermills here", True), ("mill paper", False), ("", False), (None, False)])
def test_phrase_window(spark, said, hit):
    assert one(spark, icp.phrase_hit(F.lit(said).cast("string"), ("paper", "mill"))) is hit


def test_text_columns(spark):
    assert one(spark, text.squish(F.lit(" a\t\n b  "))) == "a b"
    assert one(spark, text.title(F.lit("o'neil 3m x-y"))) == "O'Neil 3M X-Y"
    assert one(spark, text.unrepeat(F.lit("we make good robots today we make good robots today!"))) == "we make good robots today!"
    assert one(spark, text.sentences(F.lit("One. Two!\n\n- three |"))) == ["One.", "Two!", "three"]
    assert one(spark, text.usable(F.lit("A readable text of more than thirty characters."))) and not one(spark, text.usable(F.lit("short")))
    assert one(spark, text.shorten(F.lit("a b c"), 2)) == "a b…"


def test_contact_columns(spark):
    assert one(spark, contacts.name_from_email(F.lit("jane.doe-2@x.com"))) == "Jane Doe" and one(spark, contacts.name_from_email(F.lit("info@x.com"))) == ""
    assert one(spark, contacts.email_patterns(F.lit("jane"), F.lit("smith"), F.lit("x.com")))[:3] == ["jane.smith@x.com", "jane@x.com", "janesmith@x.com"]
    assert one(spark, contacts.slug_fits(F.lit("https://linkedin.com/company/acme-robotics/"), F.lit("Acme"), F.lit("acme.com")))
    assert not one(spark, contacts.slug_fits(F.lit("https://linkedin.com/company/t"), F.lit("Tesla"), F.lit("tesla.com")))
    assert one(spark, contacts.display_name(F.lit(" "), F.lit("A"), F.lit("B"))) == "A B"
    assert one(spark, urls.candidate_pages(F.lit("acme.com/x"), ["", "/about"], 2)) == ["https://acme.com", "https://acme.com/about"]


def test_template_and_structure(spark):
    df = spark.createDataFrame([("Ann", None)], "name string, city string")
    assert df.select(drafts.render("Hi {name} in {city}!", df.columns).alias("v")).first().v == "Hi Ann in !"
    assert df.select(drafts.render("{none}", df.columns).alias("v")).first().v == "ERROR: no column none"
    import hashlib

    for mail in ("a@b.c", "x", ""):
        assert one(spark, drafts.structure(F.lit(mail))) == int(hashlib.md5(mail.encode()).hexdigest(), 16) % 5


def test_size_and_rounding(spark):
    assert one(spark, scores.personalization(F.lit(0.25), F.lit(1))) == 26  # 25.5 goes to the even neighbour
    assert one(spark, scores.personalization(F.lit(None).cast("double"), F.lit(0))) == 0


def test_page_parser():
    row = html.page_row("<title>T</title><h2>A</h2><h2>a</h2><script>no()</script><p>Hello &amp; <b>you</b></p><p>two")
    assert (row["title"], row["headings"], row["text"], row["status"]) == ("T", ["A"], "A\na\nHello & you\ntwo", "ok")
    assert html.page_row(None)["status"] == "fetch_failed" and html.page_row("<br>")["status"] == "empty"
    assert html.described('{"@graph": [{"name": "Acme", "slogan": " go  on "}]}') == ["go on", "Acme"] and html.described("{") == []


def test_leads_in_and_out(spark, tmp_path):
    source = tmp_path / "leads.csv"
    source.write_text('Company,first_name,last_name,email,note\n"A ""quoted"", Inc",Jane,Doe,j@a.com,x\n═════ REVIEW,,,,\n,,,,\nB,Bob,,b@b.com,"two\nlines"\n')
    leads = files.read_leads(spark, str(source))
    assert [(r.company, r.name, r.note) for r in leads.orderBy("company").collect()] == [('A "quoted", Inc', "Jane Doe", "x"), ("B", "Bob", "two\nlines")]
    files.write_table(leads, str(tmp_path / "out"))
    assert files.read_leads(spark, str(tmp_path / "out")).exceptAll(leads).count() == 0
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        files.read_leads(spark, str(tmp_path / "bad.csv"))
    assert files.company_table(spark.createDataFrame([("A", 1)], "company string, lead_score int")).columns[:3] == ["email", "name", "company"]


def test_prepare_and_draft(spark):
    leads = spark.createDataFrame([("1", "a@x.com", "X", "x.com"), ("2", "bad", "Y", "")], "id string, email string, company string, website string")
    pages = spark.createDataFrame([("https://x.com", "<p>X provides data tools for many small engineering teams.</p>")], "url string, html string")
    ready = engine.prepare(leads, pages, spark.createDataFrame([("x.com", True)], "domain string, has_mx boolean"))
    by = {r.id: r for r in ready.collect()}
    assert by["1"].website_status == "ok" and by["1"].verification_status == "valid" and by["2"].website_status == "missing" and by["2"].verification_status == "invalid format"
    out = {r.id: r for r in engine.draft(ready, spark.createDataFrame([("1", "Subject: Idea\n\nOne engineering word.\n\nTwo.\n\nThree.")], "id string, raw string"), "id").collect()}
    assert out["1"].generated_subject == "Idea" and "not_three" not in out["1"].quality_warnings and out["2"].generated_email.startswith("ERROR:")
    assert {r.warning for r in engine.review(engine.draft(ready, spark.createDataFrame([], "id string, raw string"), "id")).collect()} >= {"generation_failed"}


def test_regions(spark):
    df = spark.createDataFrame([(1, "offices in Munich and Paris")], "k int, t string")
    assert lookups.resolve_places(df, "t", "k", lookups.places(spark)).first().region_key in ("germany", "france")


def test_stream_keeps_the_first_of_each_domain(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('https://a.com/1', timestamp'2024-01-01 00:00:00'), ('https://www.a.com/2', timestamp'2024-01-01 00:00:01'), ('https://b.io', timestamp'2024-01-01 00:00:02'), ('https://x.com', timestamp'2024-01-01 00:00:03') t(url, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    q = intake.run_batches(intake.first_seen(stream), lambda df, _: seen.extend(r.domain for r in df.select("domain").collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == ["a.com", "b.io"]


def test_long_pages_are_read_to_their_end(spark):
    page = "<title>T</title><a href=\"/first\">one</a>" + "<p>some words</p>" * 150_000 + "<h2>Late</h2><p>the end</p><a href=\"/last\">two</a>"
    assert len(page) > 2_000_000
    pages = spark.createDataFrame([(1, "https://x.com", page)], "page_id long, url string, html string")
    assert [r.href for r in html.links(pages, "page_id").orderBy("pos").collect()] == ["https://x.com/first", "https://x.com/last"]
    row = html.parse_pages(pages, ["page_id"]).first()
    assert row.headings == ["Late"] and row.text.endswith("the end\ntwo")
