"""Saved answers of search engines, JSON or HTML, as one table: what each engine calls things is data, not code."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.functions.text import strip
from tessera.operators.ranking import top
from tessera.sources.html import VOID, bound_batches


@dataclass(frozen=True)
class Json:
    """Where a JSON answer keeps its results, and the names of their fields; an empty place is the answer itself."""

    place: str
    title: str
    url: str
    snippet: str
    published: str = ""
    engines: str = ""  # a list of the engines that an aggregator has asked
    needs_url: bool = False


@dataclass(frozen=True)
class Html:
    """Which element is a result (tag.class; empty: each link is one), which link in it counts first, and where the rest stands."""

    item: str
    link: str
    snippet: str
    published: str
    own: str  # hosts with this in them are the engine's
    least: int = 1  # characters of a link's text
    after_slug: bool = False  # the text shows the address before the title


# The engines' own names for the parts of their answers.
JSON_ENGINES = {
    "serper": Json("organic", "title", "link", "snippet"),
    "ddgs": Json("", "title", "href", "body"),
    "searxng": Json("results", "title", "url", "content", "publishedDate", "engines", True),
}
HTML_ENGINES = {
    "mojeek": Html("li.result", "a.ob", "p.s", "span.date", "mojeek.com"),
    "brave": Html("", "a", "", "", "brave.com", 10, True),
}
COLUMNS = ["key", "rank", "title", "url", "snippet", "published", "engine"]
#: Results of one answer that are looked at, as callers of these engines ask for.
MOST = 10


def read_json(answers: DataFrame, engine: str, layout: Json, most: int = MOST) -> DataFrame:
    """(key, rank, title, url, snippet, published, engine) of answers (key, raw); text that is no such JSON has no results."""
    fields = {layout.title, layout.url, layout.snippet, layout.published} - {""}
    item = "struct<" + ", ".join([*(f"`{f}`: string" for f in sorted(fields)), *([f"`{layout.engines}`: array<string>"] if layout.engines else [])]) + ">"
    listed = F.when(F.ltrim("raw").startswith("["), F.col("raw"))  # one object is no list of one
    got = F.from_json(listed, f"array<{item}>") if not layout.place else F.from_json("raw", f"struct<`{layout.place}`: array<{item}>>")[layout.place]
    rows = answers.select("key", F.posexplode(got).alias("pos", "r"))
    of = lambda name: F.coalesce(F.col("r")[name], F.lit("")) if name else F.lit("")
    asked = F.array_join(F.col("r")[layout.engines], ", ") if layout.engines else F.lit("")
    said = F.when(F.coalesce(asked, F.lit("")) != "", F.concat(F.lit(f"{engine}("), asked, F.lit(")"))).otherwise(engine)
    kept = rows.select("key", "pos", of(layout.title).alias("title"), of(layout.url).alias("url"), of(layout.snippet).alias("snippet"), of(layout.published).alias("published"), said.alias("engine"))
    return ranked(kept.filter(F.col("url") != "") if layout.needs_url else kept, most)


def ranked(rows: DataFrame, most: int) -> DataFrame:
    placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("pos")))
    return placed.filter(F.col("rank") <= most).select(*COLUMNS)


class Elements(HTMLParser):
    """Elements of the wanted tags in order, each with the result that it stands in, its classes, address and text."""

    def __init__(self, wanted: set[str], item: str) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted, (self.item_tag, _, self.item_class) = wanted, item.partition(".")
        self.found: list[dict] = []
        self.stack: list[tuple[str, int | None, dict | None]] = []
        self.items = 0
        self.inside: list[int] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if tag in VOID:
            return
        item = element = None
        if self.item_tag and tag == self.item_tag and self.item_class in classes:
            self.items += 1
            item = self.items
            self.inside.append(item)
        if tag in self.wanted:
            element = {"item": self.inside[-1] if self.inside else 0, "tag": tag, "classes": classes, "href": a.get("href"), "said": []}
            self.found.append(element)
            self.open.append(element)
        self.stack.append((tag, item, element))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.stack):
            return
        while True:
            last, item, element = self.stack.pop()
            if item is not None:
                self.inside.remove(item)
            if element is not None:
                self.open = [e for e in self.open if e is not element]
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if data.strip() and not (self.stack and self.stack[-1][0] in ("script", "style")):
            for element in self.open:
                element["said"].append(data.strip())


ELEMENT = pa.list_(pa.struct([("item", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("href", pa.string()), ("said", pa.string())]))


def elements(answers: DataFrame, layout: Html) -> DataFrame:
    """(key, pos, item, tag, classes, href, said): the elements that a layout names, of answers (key, raw)."""
    wanted = {s.partition(".")[0] for s in (layout.link, layout.snippet, layout.published) if s}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                reader = Elements(wanted, layout.item)
                reader.feed(raw or "")
                reader.close()
                rows.append([e | {"said": " ".join(e["said"])} for e in reader.found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, ELEMENT)], ["key", "e"])

    bound_batches(answers)
    kind = answers.schema["key"].dataType.simpleString()
    read = answers.select("key", "raw").mapInArrow(run, f"key {kind}, e array<struct<item: int, tag: string, classes: array<string>, href: string, said: string>>")
    return read.select("key", F.posexplode("e").alias("pos", "e")).select("key", "pos", "e.*")


def is_a(selector: str) -> Column:
    tag, _, name = selector.partition(".")
    return (F.col("tag") == tag) & (F.array_contains("classes", name) if name else F.lit(True))


def read_html(answers: DataFrame, engine: str, layout: Html, most: int = MOST) -> DataFrame:
    """(key, rank, title, url, snippet, published, engine) of saved pages (key, raw).

    Within results the named link counts before any other, and the first snippet and date; results whose link leads nowhere or to the engine
    are none. Where each link is a result, each address counts once.
    """
    found = elements(answers, layout)
    outside = F.col("href").rlike("^https?://[^/?#]") & ~F.contains(urls.authority(F.col("href")), F.lit(layout.own))
    if not layout.item:
        title = F.col("said")
        if layout.after_slug:
            last = F.substring_index(F.regexp_replace(urls.path(F.col("href")), "/+$", ""), "/", -1)
            rest = F.substr("said", F.position(last, F.col("said")) + F.length(last))
            title = strip(F.when((last != "") & F.contains(F.col("said"), last), rest).otherwise(F.col("said")))
        links = found.filter(is_a(layout.link) & F.col("href").isNotNull() & outside & (F.length("said") >= layout.least))
        links = links.withColumn("title", title).filter("title <> ''")
        once = top(links, ["key", "href"], [F.col("pos")])
        return ranked(once.select("key", "pos", "title", F.col("href").alias("url"), F.lit("").alias("snippet"), F.lit("").alias("published"), F.lit(engine).alias("engine")), most)
    inside = found.filter("item > 0")
    tag = layout.link.partition(".")[0]
    links = top(inside.filter(is_a(tag) & F.col("href").isNotNull()), ["key", "item"], [F.when(is_a(layout.link), 0).otherwise(1), F.col("pos")])
    links = links.filter(outside & (F.col("said") != "")).select("key", "item", F.col("item").alias("pos"), F.col("said").alias("title"), F.col("href").alias("url"))
    more = inside.groupBy("key", "item").agg(*(F.min_by(F.when(is_a(s), F.col("said")), F.when(is_a(s), F.col("pos"))).alias(c) if s else F.lit("").alias(c) for c, s in (("snippet", layout.snippet), ("published", layout.published))))
    both = links.join(more, ["key", "item"])
    return ranked(both.select("key", "pos", "title", "url", F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("published", F.lit("")).alias("published"), F.lit(engine).alias("engine")), most)


def read_answers(answers: DataFrame, most: int = MOST) -> DataFrame:
    """Results of answers (key, engine, raw) of all engines that are known here, in one schema; answers of others have none."""
    parts = [read_json(answers.filter(F.col("engine") == name), name, layout, most) for name, layout in JSON_ENGINES.items()]
    parts += [read_html(answers.filter(F.col("engine") == name), name, layout, most) for name, layout in HTML_ENGINES.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
