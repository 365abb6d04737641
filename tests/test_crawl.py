"""Refill, failure memory, site texts, lexicon, geography and translation on a miss: against plain versions, and edge rows."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tessera.operators import cooldown, expansion, lexicon, lookups, ordering, ranking, refill, search, translation
from tessera.sources import maintext
from tessera.streaming import cooldown as streamed

# --- refill ------------------------------------------------------------------------------------------------------------


def plain_refill(ranked, passes, limit, step):
    done, kept, ranges = 0, [], []
    while len(kept) < limit and done < len(ranked):
        upto = min(done + (step(limit, len(kept), done) if done else limit), len(ranked))
        kept += [x for x in ranked[done:upto] if passes(x)]
        ranges.append(upto - done)
        done = upto
    return kept, ranges


@pytest.mark.parametrize("limit, every, step", [(5, 7, refill.needed), (5, 7, refill.at_the_rate), (3, 1, refill.needed), (50, 9, refill.at_the_rate), (0, 2, refill.needed)])
def test_refill_tests_no_more_than_it_must(spark, limit, every, step):
    rng = random.Random(limit)
    rows = [(rng.randrange(90), rng.randrange(1000), i) for i in range(300)] + [(None, 0, 999)]
    df = spark.createDataFrame(rows, "dom int, score int, id int").repartition(5)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def costly(dom):
        calls.add(1)
        return dom % every == 0

    found = refill.refill(df, "dom", [F.desc("score"), F.col("id")], lambda part: part.filter(costly("dom")), limit, step)
    best = {}
    for dom, score, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        best.setdefault(dom, i)
    best.pop(None)
    ranked = list(best)
    want, ranges = plain_refill(ranked, lambda d: d % every == 0, limit, step)
    assert calls.value == found.tested == sum(ranges) and found.ranges == ranges  # each candidate once, and none beyond the ranges
    got = found.rows.orderBy("place").collect()
    assert [r.dom for r in got] == want and all(ranked[r.place - 1] == r.dom for r in got)


def test_refill_of_nothing_and_places(spark):
    df = spark.createDataFrame([("", 1), (None, 2)], "k string, n int")
    found = refill.refill(df, "k", [F.col("n")], lambda part: part.filter("n > 0"), 3)
    assert found.rows.count() == 0 and found.tested == 0 and set(found.rows.columns) == {"k", "n", "place"}
    numbers = list(range(500))
    random.Random(2).shuffle(numbers)
    placed = ordering.placed(spark.createDataFrame([(n,) for n in numbers], "n int").repartition(7), [F.desc("n")]).collect()
    assert sorted((r.place, r.n) for r in placed) == [(i + 1, 499 - i) for i in range(500)]


def test_running_totals_and_lanes(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(-5, 9)) for i in range(400)]
    got = ordering.totals_before(spark.createDataFrame(rows, "k int, v int").repartition(6), [F.col("k")], F.col("v"), "t").collect()
    assert sorted((r.k, r.t) for r in got) == [(k, sum(v for _, v in rows[:k])) for k in range(400)]
    lanes = [(lane, pos, f"t{rng.randrange(60)}") for lane in ("a", "b", "c") for pos in range(rng.randrange(5, 50))]
    want, seen = [], set()
    for turn in range(50):
        for lane in ("a", "b", "c"):
            mine = [r for r in lanes if r[0] == lane]
            if turn < len(mine) and mine[turn][2] not in seen:
                seen.add(mine[turn][2])
                want.append(mine[turn][2])
    df = spark.createDataFrame(lanes, "lane string, pos int, text string").repartition(3)
    assert [r.text for r in ranking.interleave(df).orderBy("place").collect()] == want
    assert [r.place for r in ranking.interleave(df).orderBy("place").collect()] == list(range(1, len(want) + 1))


def test_queries_of_regions(spark):
    rows = spark.createDataFrame([("Wood pulp traders for SMEs", " Peru "), ("timber", None), ("timber", None)], "phrase string, region string")
    got = {(r.phrase, r.place): r.query for r in search.region_queries(rows).collect()}
    assert len(got) == 11 and got[("Wood pulp traders for SMEs", 5)] == '"wood pulp traders" Peru' and got[("Wood pulp traders for SMEs", 1)] == "list of Wood pulp traders for SMEs in Peru"
    assert got[("timber", 0)] == "timber companies in "


# --- failure memory ------------------------------------------------------------------------------------------------------


def plain_cooldown(rows, wide):
    until, out = {}, {}
    for key, who, at, ok in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        made = not (who in until and until[who] > at)
        if made:
            until.pop(who, None)
            if not ok:
                until[who] = at + wide
        out[key] = (made, until.get(who))
    return out


def attempts(seed, many, gap):
    rng = random.Random(seed)
    at, rows = 1_700_000_000_000_000, []
    for i in range(many):
        at += rng.choice([0, 1, 5_000_000, gap, gap * 3, 700_000_000 * (rng.random() < 0.05)])
        rows.append((i, rng.choice(["a", "a", "b", "c"]), at, rng.choice([True, False, False, None])))
    return rows


@pytest.mark.parametrize("gap", [1_000_000, 100_000_000, 300_000_000])
def test_cooldown_equals_a_plain_walk(spark, monkeypatch, gap):
    monkeypatch.setattr(cooldown, "BUCKET", 2)  # so that stretches cross buckets
    rows = attempts(gap, 800, gap) + [(9001, None, 5, True), (9002, "a", None, False)]
    df = spark.createDataFrame([(k, w, a, o, "x") for k, w, a, o in rows], "id long, who string, us long, ok boolean, until string").withColumn("t", F.timestamp_micros("us")).repartition(3)
    got = {r.id: (r.made, r.u) for r in cooldown.attempted(df, "id", "who", "t", "ok").withColumn("u", F.unix_micros("until")).collect()}
    assert got == plain_cooldown(rows, 600_000_000)
    assert cooldown.attempted(df.limit(0), "id", "who", "t", "ok").count() == 0


def test_a_busy_instance_is_cut_at_its_gaps(spark):
    rows = [(i, "hot", i * 50_000_000 + (i // 40) * 700_000_000) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, instance string, at long")
    cut = cooldown.stretches(df).groupBy("stretch").agg(F.count("*").alias("n")).collect()
    assert len(cut) == 10 and {r.n for r in cut} == {40}


def test_expiry_and_success(spark):
    rows = [(1, 0, False), (2, 599, True), (3, 600, False), (4, 1199, True), (5, 1200, True), (6, 1201, False)]
    df = spark.createDataFrame([(k, s * 1_000_000, ok) for k, s, ok in rows], "k int, us long, ok boolean").select("k", F.lit("x").alias("w"), F.timestamp_micros("us").alias("t"), "ok")
    assert [r.made for r in cooldown.attempted(df, "k", "w", "t", "ok").orderBy("k").collect()] == [True, False, True, False, True, True]


def test_stream_equals_batch(spark, tmp_path):
    rows = attempts(3, 300, 200_000_000)
    df = spark.createDataFrame(rows, "id long, who string, us long, ok boolean").withColumn("t", F.timestamp_micros("us"))
    for i in range(3):  # three files, taken one after the other
        df.filter(F.col("id").between(i * 100, i * 100 + 99)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = streamed.attempted(source, "id", "who", "t", "ok").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    show = lambda d: sorted((r.id, r.made, r.u) for r in d.withColumn("u", F.unix_micros("until")).collect())
    assert show(spark.read.parquet(str(tmp_path / "out"))) == show(cooldown.attempted(df, "id", "who", "t", "ok"))


# --- site texts -----------------------------------------------------------------------------------------------------------


class Tree(HTMLParser):
    """A page as nested lists [tag, attributes, children], unclosed elements ending with the one around them."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.path = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.path[-1][2].append(node)
        if tag not in maintext.VOID:
            self.path.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.path):
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.path[-1][2].append(data)


def walk(node, skip=True):
    for child in node[2]:
        if isinstance(child, str):
            yield child
        elif not skip or child[0] not in maintext.LEFT_OUT:
            yield from walk(child, skip)


def first(node, test):
    for child in node[2]:
        if not isinstance(child, str) and child[0] not in maintext.LEFT_OUT:
            if test(child):
                return child
            if found := first(child, test):
                return found


def plain_lines(node):
    return [x for t in walk(node) for x in t.strip().splitlines() if x.strip()]


def plain_meta(root):
    def tags(node):
        for c in node[2]:
            if not isinstance(c, str):
                yield c
                yield from tags(c)

    found = list(tags(root))
    title = next(("".join(x for x in t[2] if isinstance(x, str)).strip() for t in found if t[0] == "title"), "")
    named = lambda k, v: next((t[1].get("content", "").strip() for t in found if t[0] == "meta" and t[1].get(k) == v), "")
    return list(dict.fromkeys(x for x in (title, named("name", "description"), named("property", "og:description")) if x))


def plain_page(html):
    root = Tree(html or "").root
    target = first(root, lambda n: n[0] == "main") or first(root, lambda n: n[0] == "article") or first(root, lambda n: n[1].get("role") == "main")
    return "\n".join(plain_meta(root)), (None if target is None else "\n".join(plain_lines(target))), "\n".join(plain_lines(root))


PAGES = [
    None, "", "just words", "<title> A </title>", "<main></main><p>left out</p>", "<title>T</title><meta name=description content=' D '><meta property='og:description' content=D><body><p>one<p>two <b>bold</b></body>",
    "<nav>menu</nav><article>first<br>line\nlines</article><article>second</article><div role=main>no</div>", "<div role='main'>yes<form>no</form></div>", "<header><main>hidden</main></header><main>shown<!-- c --> &amp; more</main>tail",
    "<p><a href=x>link</a> text <script>no()</script></p></div></p>", "<svg><title>icon</title></svg><title>Page</title>é &lt;x&gt;",
]


def test_page_texts_equal_a_tree_walk(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    pages = PAGES + pages + [p.replace("<article>", "<div role=main>").replace("</article>", "</div>") for p in pages]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(pages)], "id int, html string, step string")
    got = {r.id: r for r in maintext.main_text(maintext.parse_parts(df, ["id"])).collect()}
    for i, page in enumerate(pages):
        meta, target, whole = plain_page(page)
        assert got[i].meta == meta, page
        if target is not None:
            assert got[i].step in maintext.CONTAINERS and got[i].body == target, page
        elif got[i].step == "whole":
            assert got[i].body == whole, page
    texts = {r.id: r.text for r in maintext.page_texts(df, ["id"]).collect()}
    assert texts[0] is None and texts[1] is None and texts[3] == "A\n\nA" and texts[4] is None and texts[5] == "T\nD\n\nT\none\ntwo\nbold"
    assert maintext.page_texts(df.limit(0), ["id"]).count() == 0


def test_scored_blocks_leave_links_out(spark):
    long = "We make machines that saw wood and have made them for more than thirty years in our own works. " * 2
    html = f"<div><ul>{'<li><a href=x>Link to a page</a></li>' * 8}</ul></div><div><p>{long}</p><p>{long} <a href=y>more</a></p></div><div><a href=z>Imprint and other legal pages</a></div>"
    row = maintext.main_text(maintext.parse_parts(spark.createDataFrame([(1, html), (2, "<ul>" + "<li><a href=x>All is a link here</a></li>" * 9 + "</ul>")], "id int, html string"), ["id"])).orderBy("id").collect()
    assert row[0].step == "scored" and row[0].body == f"{long.strip()}\n{long.strip()}\nmore"
    assert row[1].step == "whole" and row[1].body.count("All is a link here") == 9


def test_crawl_adds_about_cleans_and_cuts(spark):
    page = lambda body: f"<html><head><title>TestCo</title><meta name='description' content='We build widgets for teams'></head><body><main>{body}</main></body></html>"
    pages = [
        ("https://testco.com", page("<p>TestCo is the leading widget platform.</p><p>Menu of the site and more</p><p>short</p>")),
        ("https://testco.com/about", page("<p>TESTCO IS THE LEADING WIDGET PLATFORM.</p><p>Founded in a garage, long ago.</p><p>posted 5 min ago by someone</p>")),
        ("http://only.about/x/about", page("<p>Only the second page says this.</p>")), ("https://empty.org", "<main>tiny</main>"),
    ]
    sites = [("a", " testco.com "), ("b", "http://only.about/x/"), ("c", "https://empty.org"), ("d", None), ("e", ""), ("f", "https://unknown.org")]
    got = {r.site: (r.url, r.text) for r in maintext.crawl(spark.createDataFrame(sites, "site string, url string"), spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got["a"] == ("https://testco.com", "We build widgets for teams\nTestCo is the leading widget platform.\nFounded in a garage, long ago.")
    assert got["b"][1] == "We build widgets for teams\nOnly the second page says this."
    assert [got[k][1] for k in "cdef"] == [None] * 4 and got["d"][0] is None
    cut = maintext.crawl(spark.createDataFrame(sites[:1], "site string, url string"), spark.createDataFrame(pages, "url string, html string"), 27).first().text
    assert cut == "We build widgets for teams"


# --- lexicon ---------------------------------------------------------------------------------------------------------------

CLUSTERS = [("1", ["timber", "wood", "Lumber ", "sawmill", "plywood"]), ("2", ["waste management", "recycling"]), ("3", ["ev", "electric vehicle"]), ("4", ["wood", "pellets"])]


def look(spark, phrase, tokens, *more):
    base = spark.createDataFrame([(c, t) for c, terms in CLUSTERS for t in terms], lexicon.CLUSTER)
    profiles = spark.createDataFrame([("p", phrase, tokens)], "profile string, phrase string, tokens array<string>")
    return {(r.token, r.term) for r in lexicon.spoken_for(profiles, lexicon.merged(base, *more)).collect()}


def test_lexicon_is_symmetric_and_keeps_who_speaks(spark):
    assert look(spark, "Timber merchants", ["timber", "merchants"]) == {("timber", t) for t in ("wood", "lumber", "sawmill", "plywood")}
    assert look(spark, "sawmills", ["sawmills"]) == {("sawmills", t) for t in ("timber", "wood", "lumber", "plywood")}
    assert {t for _, t in look(spark, "wood", ["wood"])} == {"timber", "lumber", "sawmill", "plywood", "pellets"}  # both clusters of wood, not merged
    assert ("pellets", "timber") not in look(spark, "pellets", ["pellets"])
    assert look(spark, "Waste Management firms", ["waste", "management"]) == {("waste", "recycling"), ("management", "recycling")}
    assert look(spark, "nowaste managements", ["x"]) == {(None, "recycling")}  # held anywhere, said of no token
    assert look(spark, "developers", ["developers"]) == set() == look(spark, "quux widgetry", ["quux"]) == look(spark, None, [])


def test_terms_inside_words_meet_as_substrings(spark):
    rng = random.Random(5)
    make = lambda n: " ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(n))
    phrases, terms = [make(rng.randrange(1, 6)) for _ in range(40)], {make(rng.randrange(2, 5)) for _ in range(80)}
    held = spark.createDataFrame([(p,) for p in phrases], "p string").select("p", lexicon.inner_phrases(F.col("p"), 5).alias("i")).collect()
    for r in held:
        assert {t for t in terms if t in r.p} == terms & set(r.i), r.p


def test_overrides_are_read_and_broken_files_are_not(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"timber": ["xylophonics", " ", 7], "bad": "no list", " ": ["x"], "n": 5, "none": null}')
    rows = lexicon.read_overrides(spark, str(tmp_path / "good.json"))
    assert sorted(r.term for r in rows.collect()) == ["7", "timber", "xylophonics"]
    assert look(spark, "xylophonics", ["xylophonics"], rows) == {("xylophonics", "timber"), ("xylophonics", "7")}
    assert {"xylophonics", "sawmill"} <= {t for _, t in look(spark, "timber", ["timber"], rows)}
    (tmp_path / "bad.json").write_text("{ not json")
    for path in ("bad.json", "missing.json"):
        assert lexicon.read_overrides(spark, str(tmp_path / path)).count() == 0
    (tmp_path / "list.json").write_text("[1, 2]")
    assert lexicon.read_overrides(spark, str(tmp_path / "list.json")).count() == 0


def test_no_geography_among_terms(spark):
    bad = ["uganda", "ugandan", "kampala", "ethiopia", "brazil", "brazilian", "addis ababa", "new york", "kenyans", "swedish", "ivory coast", "saudi", "hungarian", "cuban", "ethiopians"]
    good = ["arabica", "brazil nuts", "coffee", "wood pulp", "e-commerce maker"]
    other = ["ab", "solutions", "Arabica", "one two three four", "platform", "", None, "x1y"]
    terms = spark.createDataFrame([(t,) for t in bad + good + other], "term string")
    geo = lexicon.geography(lookups.places(spark))
    assert sorted(r.term for r in lexicon.good_terms(terms, geo).collect()) == sorted(good)
    assert sorted(r.term for r in lexicon.good_terms(terms, geo, anywhere=True).collect()) == sorted(set(good) - {"brazil nuts"})


# --- translation -------------------------------------------------------------------------------------------------------------


def test_only_misses_are_translated_in_place(spark):
    names = "id int, summary string, facts string, said string"
    rows = [(1, "premium timber", "a | b", "x"), (2, "kereste | a", "a | kereste | b | a", "x"), (3, None, None, "x"), (4, "", "b", "x"), (4, "", "b", "x"), (None, "z" * 5000, None, "y")]
    answers = [("kereste", "auto", "en", " timber "), ("a", "auto", "en", "A"), ("b", "auto", "en", " "), ("b", "auto", "de", "B"), ("kereste | a", "auto", "en", "quality timber"), ("z" * 5000, "auto", "en", "no"), ("kereste", "auto", "en", "zzz")]
    shown = F.contains(F.coalesce("summary", F.lit("")), F.lit("timber"))
    df = spark.createDataFrame(rows, names)
    got = translation.localize(df, shown, spark.createDataFrame(answers, "text string, src string, tgt string, result string"), ["facts"], ["summary"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "premium timber", "a | b", "x", False), (2, "quality timber", "A | timber | b | A", "x", True), (3, None, None, "x", False), (4, "", "b", "x", True), (4, "", "b", "x", True), (None, "z" * 5000, None, "y", True)], key=repr)
    assert translation.localize(df.limit(0), shown, spark.createDataFrame([], "text string, src string, tgt string, result string"), ["facts"]).count() == 0


def test_profiles_in_another_language(spark):
    native = spark.createDataFrame([("sustainability", ["duurzaamheid"], ""), ("consultancy", ["advies"], ""), ("sustainability consultancy", ["duurzaamheidsadvies"], ""), ("smes", ["kleine", "bedrijven"], "kleine bedrijven"), ("wood trade", ["hout", "handel"], "hout en handel")], "term string, kept array<string>, phrase string")
    parts = spark.createDataFrame(
        [("p", "core", "sustainability", ["sustainability"]), ("p", "core", "consultancy", ["consultancy"]), ("p", "phrase", "sustainability consultancy", ["sustainability", "consultancy"]), ("p", "qualifier", "smes", ["smes"]), ("q", "phrase", "wood trade", ["wood", "trade"]), ("q", "core", "unknown", ["unknown"])],
        "profile string, role string, term string, tokens array<string>",
    )
    got = {(r.profile, r.term): (r.strong, r.tokens) for r in translation.native_profile(parts, native).collect()}
    assert got == {
        ("p", "duurzaamheid"): (True, ["sustainability"]), ("p", "advies"): (True, ["consultancy"]), ("p", "duurzaamheidsadvies"): (True, ["consultancy", "sustainability"]),
        ("p", "kleine"): (False, ["smes"]), ("p", "bedrijven"): (False, ["smes"]), ("p", "kleine bedrijven"): (False, ["smes"]),
        ("q", "hout en handel"): (True, ["trade", "wood"]), ("q", "hout"): (False, []), ("q", "handel"): (False, []),
    }
    forms = {(r.term, r.native): r.safe for r in translation.native_expansion(spark.createDataFrame([("smes",), ("consultancy",), ("x",)], "term string"), native).collect()}
    assert forms == {("smes", "kleine"): False, ("smes", "bedrijven"): False, ("smes", "kleine bedrijven"): True, ("consultancy", "advies"): True}


def test_patterns_of_junk_lines_are_valid():
    assert re.compile("|".join(maintext.fixed.JUNK_LINES))


# --- expansion -----------------------------------------------------------------------------------------------------------------


def test_related_words_are_good_and_rare(spark):
    raw = '[{"word": " Pulp ", "tags": ["n", "f:2.5"]}, {"word": "day", "tags": ["f:300"]}, {"word": "pulp"}, {"word": "brazil"}, {"word": "milling", "tags": ["f:bad"]}, {"tags": []}, "x"]'
    answers = [("paper", "ml", raw), ("paper", "rel_trg", "{}"), ("", "ml", raw), ("mill", "ml", None), ("mill", "other", raw), ("mill", "ml", "[broken")]
    got = expansion.related_words(spark.createDataFrame(answers, "term string, rel string, raw string"), lexicon.geography(lookups.places(spark))).collect()
    assert sorted((r.term, r.rel, r.pos, r.word) for r in got) == [("paper", "ml", 0, "pulp"), ("paper", "ml", 4, "milling")]


def test_expansion_by_trust_and_for_whom_it_speaks(spark):
    profiles = spark.createDataFrame([("p", ["paper", "mill"], ["paper mill"]), ("q", ["coffee"], []), ("r", [], None)], "profile string, tokens array<string>, chunks array<string>")
    spoken = spark.createDataFrame([("p", "paper", "pulp mill"), ("p", None, "board"), ("p", "mill", "paper")], "profile string, token string, term string")
    model = spark.createDataFrame([("p", "Board"), ("p", "cellulose"), ("q", None)], "profile string, term string")
    related = [("paper", "ml", 0, "pulp"), ("mill", "ml", 0, "milling"), ("mill", "ml", 1, "pulp"), ("paper", "rel_trg", 0, "ink"), ("paper mill", "ml", 0, "noise"), ("paper mill", "rel_trg", 0, "ink"), ("coffee", "rel_trg", 0, "urn")]
    got = expansion.grouped(profiles, spoken, model, spark.createDataFrame(related, "term string, rel string, pos int, word string")).collect()
    assert sorted((r.profile, r.place, r.term, r.tokens) for r in got) == [
        ("p", 1, "board", []), ("p", 2, "pulp mill", ["paper"]), ("p", 3, "cellulose", []), ("p", 4, "milling", ["mill"]), ("p", 5, "pulp", ["mill", "paper"]), ("p", 6, "noise", []), ("p", 7, "ink", []), ("q", 1, "urn", []),
    ]
    assert {r.profile for r in expansion.grouped(profiles, spoken, model, spark.createDataFrame(related, "term string, rel string, pos int, word string"), 2).filter("place > 2").collect()} == set()
    keys = spark.createDataFrame([(["b", "a"], ["c", "a", "b", "c"]), (["a", "b"], [])], "core array<string>, others array<string>").select(expansion.profile_key(F.col("core"), F.col("others")).alias("k")).collect()
    assert [r.k for r in keys] == ["b a//c", "a b//"]
