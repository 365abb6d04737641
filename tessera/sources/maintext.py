"""The text of a company's site: what its pages say, by a ladder of ways to find the part that matters.

A page is read into blocks of text between block tags, with figures of words and of linked words; what to keep is decided by
columns over these blocks. First comes a page's ``main``, else its first ``article``, else what has the role ``main``. Without any, blocks are
judged by how many words they and their neighbours have and how many of these are links (the NumWords rules of
Kohlschuetter, Fankhauser and Nejdl, "Boilerplate Detection using Shallow Text Features", 2010). If they leave no more than 80 characters, the
whole body counts. Title and descriptions stand before the text, or alone where there is no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed, text
from tessera.sources.html import BLOCKS, VOID, bound_batches

#: Elements whose text is no content.
LEFT_OUT = {"script", "style", "nav", "footer", "header", "noscript", "svg", "iframe", "form"}
CONTAINERS = ("main", "article", "role")
#: Characters that scored blocks must have together.
ENOUGH = 80


class Blocks(HTMLParser):
    """Blocks of a page as (lines, characters, words, linked words, flags of containers), its title and descriptions."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.titles: list[str] = []
        self.meta: dict[str, str] = {}
        self.seen = dict.fromkeys(CONTAINERS, False)
        self.stack: list[tuple[str, str]] = []  # tag, and the container that it opened
        self.open = dict.fromkeys(CONTAINERS, False)
        self.hidden = self.linked = 0
        self.cut()

    def cut(self) -> None:
        self.fresh = True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            kind = "description" if a.get("name") == "description" else "og:description" if a.get("property") == "og:description" else ""
            if kind:
                self.meta.setdefault(kind, a.get("content", "").strip())
        if tag in BLOCKS or a.get("role") == "main":
            self.cut()
        if tag in VOID:
            return
        opened = ""
        if not self.hidden and tag not in LEFT_OUT:
            for kind, here in (("main", tag == "main"), ("article", tag == "article"), ("role", a.get("role") == "main")):
                if here and not self.seen[kind]:
                    self.seen[kind] = self.open[kind] = True
                    opened += kind + " "
        self.stack.append((tag, opened))
        self.hidden += tag in LEFT_OUT
        self.linked += tag == "a"
        if tag == "title":
            self.titles.append("")

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return
        while True:
            last, opened = self.stack.pop()
            self.hidden -= last in LEFT_OUT
            self.linked -= last == "a"
            for kind in opened.split():
                self.open[kind] = False
            if opened:
                self.cut()
            if last == tag:
                break
        if tag in BLOCKS:
            self.cut()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "title":
            self.titles[-1] += data
        said = data.strip()
        if not said or self.hidden:
            return
        if self.fresh:
            self.blocks.append({"lines": [], "chars": 0, "words": 0, "linked": 0} | {k: self.open[k] for k in CONTAINERS})
            self.fresh = False
        block, words = self.blocks[-1], len(said.split())
        block["lines"] += [x for x in said.splitlines() if x.strip()]
        block["chars"] += len(said)
        block["words"] += words
        block["linked"] += words * bool(self.linked)


BLOCK = pa.struct([("lines", pa.list_(pa.string())), ("chars", pa.int32()), ("words", pa.int32()), ("linked", pa.int32()), ("main", pa.bool_()), ("article", pa.bool_()), ("role", pa.bool_())])
PARTS = pa.schema([("title", pa.string()), ("description", pa.string()), ("og", pa.string()), ("has", pa.string()), ("blocks", pa.list_(BLOCK))])
PARTS_SQL = "title string, description string, og string, has string, blocks array<struct<lines: array<string>, chars: int, words: int, linked: int, main: boolean, article: boolean, role: boolean>>"


def page_parts(html: str | None) -> dict:
    reader = Blocks()
    reader.feed(html or "")
    reader.close()
    has = next((k for k in CONTAINERS if reader.seen[k]), "")
    return {"title": (reader.titles or [""])[0].strip(), "description": reader.meta.get("description", ""), "og": reader.meta.get("og:description", ""), "has": has, "blocks": reader.blocks}


def parse_parts(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep``, and title, description, og, has (the container that counts) and blocks of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_pylist([page_parts(h) for h in batch.column(len(keep)).to_pylist()], schema=PARTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *rows.columns], [*keep, *PARTS.names])

    bound_batches(pages)
    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html).mapInArrow(run, f"{kept}, {PARTS_SQL}")


def content(blocks: Column) -> Column:
    """The blocks that are content by their own words and links and those of their neighbours."""
    density = lambda b: F.coalesce(b["linked"] / b["words"], F.lit(0.0))

    def good(b: Column, before: Column, after: Column) -> Column:
        words, next_words, last_words = b["words"], F.coalesce(after["words"], F.lit(0)), F.coalesce(before["words"], F.lit(0))
        after_text = (words > 16) | (next_words > 15) | (last_words > 4)
        after_links = (words > 40) | (next_words > 17)
        return (density(b) <= 0.333333) & F.when(density(before) <= 0.555556, after_text).otherwise(after_links)

    return F.filter(blocks, lambda b, i: good(b, F.get(blocks, i - 1), F.get(blocks, i + 1)))


def main_text(parsed: DataFrame) -> DataFrame:
    """Adds ``meta`` and ``body`` (texts, empty where there is none) and ``step``: main, article, role, scored or whole."""
    of = lambda flag: F.filter("blocks", lambda b: b[flag])
    total = F.aggregate("scored", F.lit(0), lambda n, b: n + b["chars"])
    step = F.when(F.col("has") != "", F.col("has")).when(total > ENOUGH, "scored").otherwise("whole")
    blocks = F.when(F.col("step") == "scored", F.col("scored")).when(F.col("step") == "whole", F.col("blocks"))
    for kind in CONTAINERS:
        blocks = F.when(F.col("step") == kind, of(kind)).otherwise(blocks)
    meta = F.array_distinct(F.filter(F.array("title", "description", "og"), lambda m: m != ""))
    out = parsed.withColumn("scored", F.when(F.col("has") == "", content(F.col("blocks"))).otherwise(F.col("blocks"))).withColumn("step", step)
    return out.withColumns({"meta": F.array_join(meta, "\n"), "body": F.array_join(F.flatten(F.transform(blocks, lambda b: b["lines"])), "\n")}).drop("scored")


def page_texts(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep``, ``step``, and the text of each page: descriptions, a blank line, what it says; null if there is neither."""
    parsed = main_text(parse_parts(pages, keep, html))
    whole = F.when(F.col("body") == "", F.col("meta")).when(F.col("meta") == "", F.col("body")).otherwise(F.concat_ws("\n\n", "meta", "body"))
    return parsed.select(*keep, "step", F.nullif(whole, F.lit("")).alias("text"))


JUNK = f"(?iU)^({'|'.join(fixed.JUNK_LINES)})"


def crawl(sites: DataFrame, pages: DataFrame, most_chars: int = 3000) -> DataFrame:
    """(site, url, text): the cleaned text of each site's first page and of its ``/about`` page, from fetched ``pages`` (url, html).

    Sites (site, url) without a url, and those of which neither page says anything, have a null text. Lines are cleaned over both pages, so
    what the second repeats is left out; the result ends after ``most_chars`` characters. Of several pages with one url the
    first by its html counts.
    """
    bare = text.strip(F.col("url"))
    asked = sites.select("site", F.when(bare.rlike("^https?://"), bare).when(bare != "", F.concat(F.lit("https://"), bare)).alias("url"))
    about = F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/about"))
    wanted = asked.select("site", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("url").alias("at")), F.struct(F.lit(1).alias("n"), about.alias("at")))).alias("w"))
    wanted = wanted.select("site", "w.n", F.col("w.at").alias("url")).filter("url IS NOT NULL")
    once = pages.join(wanted.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min("html").alias("html"))
    said = wanted.join(page_texts(once, ["url"]).select("url", "text"), "url").filter("text IS NOT NULL")
    both = said.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("t"))  # two pages a site at most, if sites differ
    joined = F.array_join(F.transform("t", lambda t: t["text"]), "\n")
    cleaned = both.select("site", F.array_join(text.clean_lines(joined, JUNK), "\n").alias("clean"))
    cut = text.strip(F.substring("clean", 1, most_chars))
    return asked.join(cleaned.select("site", F.nullif(cut, F.lit("")).alias("text")), "site", "left")
