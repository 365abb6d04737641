"""Company names in encyclopedia lists: which lists and categories suit a profile, and the names that they hold.

The text of a list is taken line by line: windows over the lines of a page carry the section and the table that a line stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import contacts, fixed
from tessera.functions.text import squish, stem, stems, strip
from tessera.operators.ranking import top

BASE = "https://en.wikipedia.org/wiki/"


def clean_name(raw: Column) -> Column:
    """The bare name in a piece of wikitext: link texts, without markup and without what follows a spaced dash or a bracket."""
    s = F.coalesce(raw, F.lit(""))
    for pattern, new in ((r"\[\[(?:[^\]|]*\|)?([^\]|]+)\]\]", "$1"), (r"<ref[^>]*?/>", ""), (r"(?is)<ref.*?</ref>", ""), (r"(?s)<!--.*?-->", ""), (r"(?s)\{\{.*?\}\}", ""), (r"<[^>]+>", ""), (r"'{2,3}", ""), (r"(?sU)(?:\s+[-–—]\s+|\s*\().*$", ""), (r"[\[\]{}|*#]", "")):
        s = F.regexp_replace(s, pattern, new)
    return F.regexp_replace(squish(s), r"^[ .,\-–—\t]+|[ .,\-–—\t]+$", "")


def a_company(name: Column) -> Column:
    """2 to 80 characters, with a word of its own, and neither a body that oversees others nor a page about pages."""
    return F.length(name).between(2, 80) & ~name.rlike(fixed.NO_COMPANY) & (F.size(contacts.company_tokens(name)) > 0)


def names(pages: DataFrame, key: str = "key", text: str = "text", most: int = 80) -> DataFrame:
    """Rows (key, pos, name): the first ``most`` names of each page, from bullets, lines that begin with a link and the first cells of
    tables, each once whatever its case.

    Sections whose heading holds a word of ``fixed.WIKI_SKIPPED`` are left out. A table counts once it is closed; one that another
    table interrupts does not. Lines that show a picture have no name. A null text has no names; pages with the same key are one page, their texts in order.
    """
    lines = pages.select(F.col(key).alias("key"), F.col(text).alias("_t")).select("key", "_t", F.posexplode(F.split(F.coalesce("_t", F.lit("")), r"\r\n|[\n\r\x0B\f]")).alias("n", "line"))
    page = Window.partitionBy("key", "_t").orderBy("n")
    table = Window.partitionBy("key", "_t", "table")
    so_far = lambda flag: F.count_if(flag).over(page)
    s, low = F.col("s"), F.lower("heading")
    rows = lines.withColumn("s", strip(F.col("line"))).withColumn("heading", F.regexp_extract("s", r"^=+\s*(.+?)\s*=+$", 1))
    rows = rows.withColumn("heading", F.when(s.rlike(r"^=+\s*.+?\s*=+$"), F.col("heading"))).withColumn("skips", F.when(F.col("heading").isNotNull(), F.exists(F.array(*map(F.lit, fixed.WIKI_SKIPPED)), lambda w: F.contains(low, w))))
    rows = rows.withColumn("skips", F.coalesce(F.last("skips", True).over(page), F.lit(False))).filter("NOT skips AND heading IS NULL")
    rows = rows.withColumn("table", so_far(s.startswith("{|")))
    rows = rows.withColumn("ends", F.min(F.when(s.startswith("|}"), F.col("n"))).over(table))
    inside = (F.col("table") > 0) & (F.col("n") <= F.coalesce("ends", F.lit(1 << 30)))
    rows = rows.withColumn("inside", inside)
    # a row of a table begins with |-; its first line that is a cell or a heading decides
    cells = rows.filter("inside AND ends IS NOT NULL").withColumn("row", so_far(s.startswith("|-")))
    cell = F.when(s.startswith("|-"), strip(F.regexp_replace("s", r"^\|-+", ""))).otherwise(s)
    cells = cells.withColumn("cell", cell).filter(F.col("cell").rlike(r"^[|!]") & ~F.col("cell").rlike(r"^\|[}+]"))
    cells = top(cells, ["key", "_t", "table", "row"], [F.col("n")]).filter("cell LIKE '|%'")
    cells = cells.withColumn("cell", F.split(F.substring("cell", 2, 1 << 30), r"\|\|")[0])
    style = F.substring_index("cell", "|", 1)
    styled = F.contains(F.col("cell"), F.lit("|")) & F.contains(style, F.lit("=")) & (F.length(style) < 60)
    cells = cells.select("key", "_t", "n", F.when(styled, F.expr("substring(cell, instr(cell, '|') + 1)")).otherwise(F.col("cell")).alias("raw"))
    bullet = F.regexp_extract("s", r"^\*+\s*(.+)$", 1)
    plain = rows.filter("NOT inside").select("key", "_t", "n", F.when(bullet != "", bullet).when(s.startswith("[[") & F.contains(s, F.lit("]]")) & ~s.rlike(r"(?i)^\[\[(file|image):"), s).alias("raw")).filter("raw IS NOT NULL")
    found = plain.unionByName(cells).withColumn("name", clean_name(F.col("raw"))).filter(a_company(F.col("name"))).withColumn("_low", F.lower("name"))
    order = [F.col("_t"), F.col("n")]
    once = top(found, ["key", "_low"], order)
    placed = once.withColumn("pos", (F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1).cast("int"))
    return placed.filter(F.col("pos") < most).select("key", "pos", "name")


def speaks_of(title: Column, terms: Column) -> Column:
    """A term has the stem of a word of the title, or is inside it from four letters on."""
    low, found = F.lower(title), stems(title)
    return F.exists(terms, lambda t: F.array_contains(found, stem(t)) | ((F.length(t) >= 4) & F.contains(low, t)))


def list_titles(hits: DataFrame, profiles: DataFrame, most: int = 3) -> DataFrame:
    """(profile, pos, title) of the lists that suit profiles (profile, terms array, region, region_key), from search hits (profile, query_place, rank, title).

    A title must begin with "List of" and speak of the industry and of the region, whatever the search thought; without terms the region
    suffices. The first query with such a title counts. Profiles without a region have no lists.
    """
    low = F.lower("title")
    region = F.lower(strip(F.col("region")))
    joined = hits.join(profiles.filter(strip(F.col("region")) != ""), "profile")
    there = F.contains(low, region) | F.coalesce((F.col("region_key") != "") & F.contains(low, F.col("region_key")), F.lit(False))
    fits = joined.filter(low.startswith("list of") & ((F.size("terms") <= 0) | speaks_of(F.col("title"), F.col("terms"))) & there)
    first = fits.groupBy("profile").agg(F.min("query_place").alias("query_place"))
    once = top(fits.join(first, ["profile", "query_place"]), ["profile", "title"], [F.col("rank")])
    placed = once.withColumn("pos", F.row_number().over(Window.partitionBy("profile").orderBy("rank", "title")))
    return placed.filter(F.col("pos") <= most).select("profile", "pos", "title")


def category_titles(profiles: DataFrame) -> DataFrame:
    """(profile, query_place, category) that may hold companies of profiles (profile, phrase, region)."""
    phrase, region = strip(F.col("phrase")), strip(F.col("region"))
    bare = strip(F.regexp_replace(phrase, r"(?i)\bcompan(?:y|ies)\b", ""))
    industry = F.when(bare == "", phrase).otherwise(bare)
    industry = F.concat(F.upper(F.substring(industry, 1, 1)), F.substring(industry, 2, 1 << 30))
    named = lambda word: F.concat(F.lit("Category:"), industry, F.lit(f" companies {word} "), region)
    return profiles.filter((phrase != "") & (region != "")).select("profile", F.posexplode(F.array(named("of"), named("in"))).alias("query_place", "category"))


def category_names(profiles: DataFrame, members: DataFrame) -> DataFrame:
    """(profile, pos, name, category) from members (category, rank, title) of the first category that has companies."""
    found = category_titles(profiles).join(members, "category").withColumn("name", clean_name(F.col("title"))).filter(a_company(F.col("name")))
    first = found.groupBy("profile").agg(F.min("query_place").alias("query_place"))
    once = top(found.join(first, ["profile", "query_place"]).withColumn("_low", F.lower("name")), ["profile", "_low"], [F.col("rank"), F.col("name")])
    return once.select("profile", F.row_number().over(Window.partitionBy("profile").orderBy("rank", "name")).alias("pos"), "name", "category")


def page_url(title: Column) -> Column:
    """The address of a page: spaces are underscores, all but letters, digits and ``_.-~`` in percent codes."""
    coded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    return F.concat(F.lit(BASE), F.replace(F.replace(coded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def company_names(profiles: DataFrame, hits: DataFrame, texts: DataFrame, members: DataFrame, most: int = 60) -> DataFrame:
    """(profile, pos, name, source): names of the suiting lists (texts: title, text), then of the category, each once, with the page that has them."""
    titles = list_titles(hits, profiles)
    used = texts.join(titles.select("title").distinct(), "title", "left_semi")
    in_lists = names(used, "title", "text", most).select(F.col("key").alias("title"), F.col("pos").alias("at"), "name").join(titles, "title")
    by_list = in_lists.select("profile", F.col("pos").alias("turn"), "at", "name", page_url(F.col("title")).alias("source"))
    by_category = category_names(profiles, members).select("profile", F.lit(1 << 30).alias("turn"), F.col("pos").alias("at"), "name", page_url(F.col("category")).alias("source"))
    order = [F.col("turn"), F.col("at")]
    once = top(by_list.unionByName(by_category).withColumn("_low", F.lower("name")), ["profile", "_low"], order)
    placed = once.withColumn("pos", F.row_number().over(Window.partitionBy("profile").orderBy(*order)))
    return placed.filter(F.col("pos") <= most).select("profile", "pos", "name", "source")


def with_sources(resolved: DataFrame, named: DataFrame) -> DataFrame:
    """Resolved companies (profile, name, website) as candidates: ``discovery_source_url`` is the page that has the name, else the website."""
    found = resolved.join(named.select("profile", "name", "source"), ["profile", "name"], "left")
    return found.withColumn("discovery_source_url", F.coalesce("source", "website")).drop("source")
