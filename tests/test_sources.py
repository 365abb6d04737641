"""Encyclopedia lists, profile titles, engines' answers and figures of a run: against plain versions, and edge rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import lookups, people, seeds
from tessera.plans import engine, metrics
from tessera.sources import engines, organisations, wiki


def tables_of(lines):
    """Rows of each closed table as lists of lines, by the place where it ends; an interrupted table is gone."""
    out, held = {}, None
    for i, line in enumerate(lines):
        if line.startswith("{|"):
            held = [[]]
        elif held is not None and line.startswith("|}"):
            out[i], held = held, None
        elif held is not None:
            if line.startswith("|-"):
                held.append([])
                line = line.lstrip("|-") if not line.startswith("|-|") else line[2:].lstrip("-")
                line = line.strip()
            held[-1].append(line)
    return out


def plain_names(text, most=80):
    lines, keep = [], True
    for line in (x.strip() for x in (text or "").split("\n")):
        if m := re.fullmatch(r"=+\s*(.+?)\s*=+", line):
            keep = not any(w in m[1].lower() for w in wiki.fixed.WIKI_SKIPPED)
        elif keep:
            lines.append(line)
    closed, raws, inside = tables_of(lines), [], False
    for i, line in enumerate(lines):
        if line.startswith("{|"):
            inside = True
        elif inside and line.startswith("|}"):
            inside = False
            for row in closed[i]:
                cell = next((x for x in row if x[:1] in "|!" and x and x[:2] not in ("|+", "|}")), "!")
                if cell[0] == "|":
                    first = cell[1:].split("||")[0]
                    style, bar, rest = first.partition("|")
                    raws.append(rest if bar and "=" in style and len(style) < 60 else first)
        elif not inside and (m := re.match(r"\*+\s*(.+)", line)):
            raws.append(m[1])
        elif not inside and line.startswith("[[") and "]]" in line and not line.lower().startswith(("[[file:", "[[image:")):
            raws.append(line)
    names = {}
    for raw in raws:
        name = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]|]+)\]\]", r"\1", raw)
        name = re.sub(r"<ref[^>]*?/>|<ref.*?</ref>|<!--.*?-->|\{\{.*?\}\}|<[^>]+>|'{2,3}", "", name)
        name = re.split(r"\s+[-–—]\s+|\s*\(", name)[0]
        name = " ".join(re.sub(r"[\[\]{}|*#]", "", name).split()).strip(" .,-–—")
        if 2 <= len(name) <= 80 and not re.search(wiki.fixed.NO_COMPANY, name) and any(len(t) > 1 for t in re.split("[^a-z0-9]+", re.sub(r"(?i)\s(ltd|inc)\.?$", "", name).lower())):
            names.setdefault(name.lower(), name)
    return list(names.values())[:most]


PIECES = ["* Alpha Bank", "** [[Beta|Beta One]] – x", "* ''Gamma'' (old)", "[[Delta Works]]", "[[File:x.png]]", "== Defunct banks ==", "=== Now ===", "== See also ==", "{| class=x", "|-", "|- style=a", "|}", "| Cell A || b", "| style=\"x\" | Cell B", "! Head", "|+ Caption", "|Cell [[C|D]]", "", "plain", "* Banking Regulatory Authority", "* é", "* x", "* alpha bank", "* {{flag|de}} Epsilon <ref>a</ref>", "*", "* " + "long " * 30]


def test_names_of_lists_equal_a_plain_walk(spark):
    rng = random.Random(8)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 40))) for _ in range(150)] + [None, "", "== Defunct banks ==\n* Old Bank\n== Active ==\n* New Bank"]
    got = {}
    for r in wiki.names(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "key int, text string, n int"), most=6).orderBy("key", "pos").collect():
        got.setdefault(r.key, []).append(r.name)
        assert r.pos == len(got[r.key]) - 1
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_names(t, 6), t
    assert got[len(texts) - 1] == ["New Bank"]


def test_titles_must_speak_of_industry_and_region(spark):
    profiles = spark.createDataFrame([("a", ["insurance"], "Bangladesh", "bangladesh"), ("b", ["landscape"], "UK", "united kingdom"), ("c", ["x"], "", ""), ("d", [], "Peru", "")], "profile string, terms array<string>, region string, region_key string")
    hits = [("a", 0, 1, "List of airlines of Bangladesh"), ("a", 0, 2, "Insurance in Bangladesh"), ("a", 1, 2, "List of insurance companies in Bangladesh"), ("a", 1, 1, "List of insurers in India"), ("a", 1, 3, "List of insurance companies in Bangladesh"), ("b", 0, 1, "List of landscaping firms of the United Kingdom"), ("b", 1, 0, "List of landscape gardens, UK"), ("c", 0, 0, "List of x"), ("d", 0, 0, "list of banks in peru"), ("e", 0, 0, "List of all"), ("d", 0, 1, None)]
    got = sorted((r.profile, r.pos, r.title) for r in wiki.list_titles(spark.createDataFrame(hits, "profile string, query_place int, rank int, title string"), profiles).collect())
    assert got == [("a", 1, "List of insurance companies in Bangladesh"), ("b", 1, "List of landscaping firms of the United Kingdom"), ("d", 1, "list of banks in peru")]


def test_categories_and_where_names_come_from(spark):
    profiles = spark.createDataFrame([("a", "insurance companies", "Bangladesh"), ("b", "Company", "Peru"), ("c", "wood", None)], "profile string, phrase string, region string")
    assert sorted(r.category for r in wiki.category_titles(profiles).collect()) == ["Category:Company companies in Peru", "Category:Company companies of Peru", "Category:Insurance companies in Bangladesh", "Category:Insurance companies of Bangladesh"]
    assert spark.range(1).select(wiki.page_url(F.lit("List of A & B (é) ~*")).alias("u")).first().u == "https://en.wikipedia.org/wiki/List_of_A_%26_B_%28%C3%A9%29_~%2A"
    named = spark.createDataFrame([("a", 1, "Alpha", "S")], "profile string, pos int, name string, source string")
    resolved = spark.createDataFrame([("a", "Alpha", "https://a.com"), ("a", "Other", "https://o.com")], "profile string, name string, website string")
    assert {r.name: r.discovery_source_url for r in wiki.with_sources(resolved, named).collect()} == {"Alpha": "S", "Other": "https://o.com"}


COINCIDENCES = [
    ("Matt Crisp", "Crisp", "https://www.linkedin.com/in/mattcrisp", True), ("Matt Crisp", "Crisp", "https://www.linkedin.com/in/matt-crisp-258a1651/", True), ("Crisp", "Crisp", "https://www.linkedin.com/in/crisp", False),
    ("Jane Smith", "Acme", "https://www.linkedin.com/in/janesmith", False), ("Jonathan Raymond Crisp", "Crisp", "https://www.linkedin.com/in/label23", True), ("John Crisp", "Crisp", "https://www.linkedin.com/in/john-at-crisp", False),
    ("Mixo Oral Baloyi", "Mixo", "https://za.linkedin.com/in/mixo-oral-baloyi-8954a5122", True), ("Matt Crisp", "Crisp", None, True), (None, "Crisp", "x", False), ("Matt Crisp", None, "x", False), ("Matt Crispin", "Crisp", "https://l.com/in/mcrispin", True),
    ("Matt Crispin", "Crisp", "https://l.com/in/other", False),
]


def test_names_like_companies(spark):
    rows = spark.createDataFrame([r[:3] for r in COINCIDENCES], "name string, company string, url string")
    got = [r.c for r in rows.select(people.named_like_company(F.col("name"), F.col("company"), F.col("url")).alias("c")).collect()]
    assert got == [r[3] for r in COINCIDENCES]


def test_companies_in_titles(spark):
    titles = {"Jane Doe - Manager - Acme Corp | LinkedIn": "Acme Corp", "Jane Doe - Acme | LinkedIn": "Acme", "Jane Doe - Engineer | LinkedIn": "", "Jane - Acme - LinkedIn": "Acme", "Jane - Head of X - LinkedIn": "", "Acme | LinkedIn": "", "a - b": "", "": "", None: ""}
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in titles], "t string").select("t", people.company_of_title(F.col("t")).alias("c")).collect()}
    assert got == titles
    cases = [("About Acme Works", "Acme Works", True), ("works of acme", "Acme Works", True), ("acme only", "Acme Works Group Partners", False), ("it crisps", "Crisp Ltd", False), ("so Crisp, yes", "Crisp Ltd", True), (None, "Crisp", False), ("x", None, False), ("x", "", False)]
    rows = spark.createDataFrame([c[:2] for c in cases], "t string, c string")
    assert [r.x for r in rows.select(people.company_in_title(F.col("t"), F.col("c")).alias("x")).collect()] == [c[2] for c in cases]


def test_answers_of_engines(spark):
    rows = [("1", "serper", None), ("2", "serper", "[]"), ("3", "ddgs", "{}"), ("4", "mojeek", ""), ("5", "brave", None), ("6", "other", "{}"), ("7", "searxng", '{"results": [{"url": null}, {"url": "https://x.org", "engines": null}]}'), ("8", "ddgs", "[" + ",".join('{"title": "t%d"}' % i for i in range(15)) + "]"), ("9", "mojeek", "<li class=result><p class=s>a</p><a href='ftp://x'>t</a></li><li class=result><a href='https://y.org' class=zz>Y</a><a class='ob q' href='https://z.org'>Z</a><span class=date>1</span></li>"), ("10", "brave", "<a href='https://q.org/abc/'>q.org › abc</a><a href='https://q.org/'>0123456789</a>")]
    got = [tuple(r) for r in engines.read_answers(spark.createDataFrame([(*r, 1) for r in rows], "key string, engine string, raw string, rank int")).collect()]
    by_key = {k: sorted(r[1:] for r in got if r[0] == k) for k, _, _ in rows}
    assert [by_key[k] for k in ("1", "2", "3", "4", "5", "6")] == [[]] * 6
    assert by_key["7"] == [(1, "", "https://x.org", "", "", "searxng")]
    assert [r[:2] for r in by_key["8"]] == [(i + 1, f"t{i}") for i in range(10)]
    assert by_key["9"] == [(1, "Z", "https://z.org", "", "1", "mojeek")]
    assert by_key["10"] == [(1, "0123456789", "https://q.org/", "", "", "brave")]  # nothing follows the address in the other


def test_figures_take_no_job_of_their_own(spark, tmp_path):
    leads = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, name string")
    answers = spark.createDataFrame([(1, "Subject: A\n\nText."), (1, None), (1, "Subject: B\n\nText."), (3, None)], "k int, raw string")
    drafts = engine.draft(leads, answers, "k")
    assert drafts.count() == 4 and drafts.filter("k = 1").first().generated_subject == "A"  # of two answers one, and none doubles a lead
    run = metrics.Run()
    watched = run.watch(drafts, "drafts", **metrics.figures("drafts"))
    jobs = lambda f: (spark.sparkContext.setJobGroup(g := f"g{random.random()}", ""), f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(g)))[2]
    plain, seen = jobs(lambda: drafts.write.parquet(str(tmp_path / "a"))), jobs(lambda: watched.write.parquet(str(tmp_path / "b")))
    assert plain == seen and jobs(lambda: run.result()) == 0
    assert run.result() == {"drafts": engine.draft_counts(drafts).first().asDict()} == {"drafts": {"n_rows": 4, "n_written": 1}}
    with pytest.raises(ValueError):
        run.watch(drafts, "drafts")
    empty = metrics.Run()
    empty.watch(drafts.limit(0), "d", **metrics.figures("drafts")).write.format("noop").mode("overwrite").save()
    assert empty.of("d") == {"n_rows": 0, "n_written": 0}


def test_a_domain_with_two_answers_gives_a_lead_once(spark):
    mx = spark.createDataFrame([("a.com", True), ("A.com", False), ("b.com", False), ("b.com", False)], "domain string, has_mx boolean")
    got = lookups.verify_emails(spark.createDataFrame([("x@a.com",), ("x@b.com",), ("x@c.com",)], "email string"), "email", mx).collect()
    assert sorted((r.email, r.valid) for r in got) == [("x@a.com", True), ("x@b.com", False), ("x@c.com", True)]


def test_seeds_of_broken_answers(spark):
    rows = [("a", None), ("b", "no"), ("c", "{}"), ("d", '{"companies": "X", "local_directories": 5}'), ("e", '{"companies": [["x"], {"n": 1}, true, "Y", " y ", "Z"]}'), ("f", '{"companies": ["late"]}'), ("f", '{"companies": ["early"]}'), ("g", '{"companies": [' + ",".join(f'"c{i}"' for i in range(50)) + "]}")]
    got = seeds.seeds(spark.createDataFrame(rows, "profile string, raw string")).collect()
    assert sorted((r.profile, r.pos, r.name) for r in got if r.profile < "g") == [("e", 0, "Y"), ("e", 1, "Z"), ("f", 0, "early")]
    assert [r.pos for r in got if r.profile == "g"] == list(range(30))


def test_prompts_name_what_is_wanted(spark):
    profiles = spark.createDataFrame([("p", " wood ", "Peru"), ("q", None, None)], "profile string, phrase string, region string")
    related = spark.createDataFrame([("p", t) for t in "ihgfedcba"] + [("p", " "), ("p", None), ("p", "a")], "profile string, term string")
    got = {r.profile: r.prompt for r in seeds.prompts(profiles, related).collect()}
    assert "Industry wanted: wood\nCountry or region: Peru\nWords for the same industry: a, b, c, d, e, f, g, h\n" in got["p"] and "Words for" not in got["q"]
    found = spark.createDataFrame([("p", "directory", 0, "Chamber"), ("p", "company", 0, "X")], "profile string, kind string, pos int, name string")
    assert [r.query for r in seeds.directory_queries(found, profiles).collect()] == ["Chamber Peru"]


def test_contact_pages_of_odd_sites(spark):
    pages = spark.createDataFrame([("https://a.com/", "<p>home of a</p>"), ("https://a.com/", "<p>again</p>"), ("https://a.com/about", ""), ("https://a.com/team", None), ("https://a.com/contact", "<p>call</p>"), ("https://a.com/press", "<p>beyond</p>")], "url string, html string")
    sites = spark.createDataFrame([("a.com/shop/x",), ("a.com/shop/x",), (None,), ("",), ("https://",)], "site string")
    got = [(r.site, r.page, r.url, r.text) for r in engine.contact_pages(sites, pages).orderBy("page").collect()]
    assert got == [("a.com/shop/x", 0, "https://a.com", "again"), ("a.com/shop/x", 2, "https://a.com/contact", "call")]


def test_contacts_from_structured_data_links_and_text(spark):
    ld = lambda x: f'<script type="application/ld+json">{x}</script>'
    first = ld('{"@graph":[{"name":" "},{"name":"A Ltd","email":"mailto:Hi@a.com","telephone":"+49 30 901820","address":{"streetAddress":"Main 1","postalCode":12345,"addressCountry":{"name":"DE"}},"sameAs":["https://x.com/a?b=1",5,"https://de.linkedin.com/company/a-ltd/about"]}]}') + ld("no json")
    rows = [
        ("https://a.com", 0, "https://a.com", first + "<a href='mailto:HI@a.com?x'>m</a><a href='MAILTO:two@b.org'>m</a><a href='tel:030 901820'>t</a><a href='/partners#x'>p</a>"),
        ("https://a.com", 1, "https://a.com/about", ld('[{"name":"Other","address":" Street 5 "}, 7]') + "<a href='https://facebook.com/a'>f</a><p>other@a.com</p>"),
        ("https://b.com", 0, "https://b.com", "<p>x@other.org</p>"), ("https://b.com", 1, "https://b.com/c", "<p>Me@b.com you@b.com</p>"), ("https://b.com", 2, "https://b.com/d", "<p>late@b.com</p><a href='mailto:z@z.com'>z</a>"),
        ("https://c.com", 0, "https://c.com", None), ("https://c.com", 0, "https://c.com", None), ("https://d.com", 0, "https://d.com", ld("{}") + ld('{"@graph": {}, "name": 5, "email": "none", "sameAs": null, "address": []}')),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "site string, page int, url string, html string, name string")
    got = {r.site: tuple(r)[1:] for r in organisations.contact_bundle(df).collect()}
    assert got["https://a.com"] == ("A Ltd", "Main 1, 12345, DE", ["hi@a.com", "two@b.org"], ["+4930901820", "030901820"], ["https://x.com/a", "https://de.linkedin.com/company/a-ltd", "https://facebook.com/a"], "https://de.linkedin.com/company/a-ltd", "https://a.com/partners")
    assert got["https://b.com"] == ("", "", ["me@b.com", "you@b.com", "z@z.com"], [], [], "", "")
    assert got["https://c.com"] == got["https://d.com"] == ("", "", [], [], [], "", "")
    assert organisations.contact_bundle(df.limit(0)).count() == 0
