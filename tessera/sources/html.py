"""HTML and wikitext as tables: pages parsed in Arrow batches, links and names as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed, urls
from tessera.functions.text import squish
from tessera.operators.ranking import top

HIDDEN = {"script", "style", "noscript", "nav", "footer", "header", "aside", "form", "svg"}
BLOCKS = {"p", "div", "li", "br", "h1", "h2", "h3", "h4", "tr", "section", "article", "main", "ul", "ol", "table", "blockquote"}
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Bytes of one Arrow batch, so that a batch of very long pages still fits a worker.
BATCH_BYTES = 8 << 20


class Reader(HTMLParser):
    """Title, descriptions, headings, JSON-LD, links, and the text of the whole page and of its main part."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.headings, self.jsonld, self.links = [], {}, [], [], []
        self.kinds = []  # the class of each link
        self.text, self.main, self.stack = [], [], []
        self.hidden = self.inside = 0
        self.heading = self.ld = self.link = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and "content" in a:
            self.meta.setdefault((a.get("name") or a.get("property") or "").lower(), a["content"].strip())
        if tag in BLOCKS:
            self._put("\n")
        if tag in VOID:
            return
        self.stack.append(tag)
        self.hidden += tag in HIDDEN
        self.inside += tag in ("main", "article") or a.get("role") == "main"
        if tag in ("h1", "h2"):
            self.heading = []
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.ld = []
        if tag == "a" and a.get("href"):
            self.link = (a["href"], [], a.get("class", ""))

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while True:
            last = self.stack.pop()
            self.hidden -= last in HIDDEN
            if last in ("main", "article"):
                self.inside = max(0, self.inside - 1)
            if last == tag:
                break
        if tag in BLOCKS:
            self._put("\n")
        if tag in ("h1", "h2") and self.heading is not None:
            self.headings.append(" ".join("".join(self.heading).split()))
            self.heading = None
        if tag == "script" and self.ld is not None:
            self.jsonld.append("".join(self.ld).strip())
            self.ld = None
        if tag == "a" and self.link:
            self.links.append((self.link[0], " ".join("".join(self.link[1]).split())))
            self.kinds.append(self.link[2])
            self.link = None

    def handle_data(self, data: str) -> None:
        if self.ld is not None:
            self.ld.append(data)
        if self.stack and self.stack[-1] == "title":
            self.title.append(data)
        elif not self.hidden:
            self._put(data)
        if self.heading is not None:
            self.heading.append(data)
        if self.link:
            self.link[1].append(data)

    def _put(self, data: str) -> None:
        self.text.append(data)
        if self.inside:
            self.main.append(data)


def read(html: str | None) -> Reader:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return reader


def bound_batches(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lines(parts: list[str]) -> str:
    return "\n".join(x for x in (" ".join(p.split()) for p in "".join(parts).split("\n")) if x)


PAGE = pa.schema([("title", pa.string()), ("description", pa.string()), ("headings", pa.list_(pa.string())), ("jsonld", pa.list_(pa.string())), ("text", pa.string()), ("status", pa.string())])


def described(raw: str) -> list[str]:
    """What a JSON-LD script says of an organisation: description, slogan and name of each of its objects."""
    try:
        found = json.loads(raw)
    except ValueError:
        return []
    items = found if isinstance(found, list) else [found]
    items = [x for i in items if isinstance(i, dict) for x in (i.get("@graph") or [i])]
    return [" ".join(v.split()) for i in items if isinstance(i, dict) for k in ("description", "slogan", "name") if isinstance(v := i.get(k), str) and v.strip()]


def page_row(html: str | None) -> dict:
    r = read(html)
    description = next((r.meta[k] for k in ("description", "og:description", "twitter:description") if r.meta.get(k)), "")
    headings = list({h.lower(): h for h in reversed(r.headings) if h}.values())[::-1][:12]
    body = lines(r.main) or lines(r.text)
    status = "fetch_failed" if html is None else "ok" if body or description or headings else "empty"
    return {"title": " ".join("".join(r.title).split()), "description": description, "headings": headings, "jsonld": [t for raw in r.jsonld[:5] for t in described(raw)], "text": body, "status": status}


def only_amp(html: str) -> Column:
    """A page in which ``&amp;`` is the only character reference; of all others, whole or cut off, the ``&`` is a plain sign."""
    return F.regexp_replace(html, "&(?!amp;)", "&amp;")


def parse_pages(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep``, and title, description, headings, jsonld, text and status of each page; null html is a failed fetch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_pylist([page_row(h) for h in batch.column(len(keep)).to_pylist()], schema=PAGE)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *rows.columns], [*keep, *PAGE.names])

    bound_batches(pages)
    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html).mapInArrow(run, f"{kept}, title string, description string, headings array<string>, jsonld array<string>, text string, status string")


def links(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (key, page_url, pos, href, said): every link, its address made absolute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, base, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parsed = read(page)
                for pos, ((href, said), kind) in enumerate(zip(parsed.links, parsed.kinds, strict=True)):
                    try:
                        target = urljoin(base or "", href.strip())
                    except ValueError:
                        continue
                    out.append((k, base, pos, target, said, kind))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "page_url", "pos", "href", "said", "kind"])

    bound_batches(pages)
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), url, html).mapInArrow(run, f"key {kind}, page_url string, pos int, href string, said string, kind string")


def candidates(found: DataFrame) -> DataFrame:
    """Companies that pages link to: outside, not blocked, the first link of each domain on a page."""
    href, dom = F.col("href"), F.col("domain")
    named = found.withColumn("domain", urls.domain(href)).withColumn("source", urls.domain(F.col("page_url")))
    kept = named.filter(href.rlike("^https?://") & ~urls.blocked_domain(dom, F.col("source")) & ~urls.blocked_host(urls.authority(href)))
    first = top(kept, ["key", "domain"], [F.col("pos")])
    return first.select("key", "pos", urls.company_from_anchor(F.col("said"), dom).alias("company"), F.concat(F.lit("https://"), dom).alias("website"), "domain", F.col("page_url").alias("discovery_source_url"))


def unwrapped(href: Column, engine: str = "duckduckgo.com") -> Column:
    """The target of an engine's own redirecting link, which names it in ``uddg``; other links as they are."""
    target = F.try_url_decode(F.nullif(F.regexp_extract(href, r"[?&]uddg=([^&#]+)", 1), F.lit("")))
    return F.when(F.contains(urls.authority(href), F.lit(engine)), F.coalesce(target, href)).otherwise(href)


def search_results(found: DataFrame, engine: str = "duckduckgo.com") -> DataFrame:
    """(key, rank, url) of the results on saved search pages, from their links; each url once, without fragment and slashes at the end.

    Links with a class only count if it is a result's; links without words only if they are redirecting ones.
    """
    url = F.regexp_replace(F.regexp_replace(unwrapped(F.col("href"), engine), "#.*$", ""), "/+$", "")
    named = found.withColumn("url", url).filter(F.col("url").rlike("^https?://[^/?#]") & ~F.contains(urls.authority(F.col("url")), F.lit(engine)))
    kept = named.filter(((F.col("kind") == "") | F.contains("kind", F.lit("result"))) & ((F.col("said") != "") | F.contains("href", F.lit("uddg="))))
    once = top(kept, ["key", "url"], [F.col("pos")])
    return once.select("key", F.row_number().over(Window.partitionBy("key").orderBy("pos")).alias("rank"), "url")


SKIPPED = r"about|account|advertise|blog|category|contact|cookie|login|privacy|submit|sign-?in|sign-?up|tag|terms"
DETAIL = r"/(ai|apps?|company|companies|directory|products?|startups?|tools?)/"


def detail_links(found: DataFrame, limit: int = 30) -> DataFrame:
    """Pages of the same site that may describe one company, at most ``limit`` a page: by their path, or by words of the link that
    say more than an invitation to click. Query and fragment are left out, the scheme is that of the page."""
    href, base = F.col("href"), F.col("page_url")
    path, said = F.lower(urls.path(href)), squish(F.coalesce("said", F.lit("")))
    own = href.rlike("(?i)^https?://[^/?#]") & (urls.domain(href) == urls.domain(base))
    worth = path.rlike(DETAIL) | ((F.length(said) >= 2) & ~said.rlike(fixed.CALL_TO_ACTION))
    kept = found.filter(own & ~path.isin("", "/") & ~path.rlike(SKIPPED) & worth)
    target = F.regexp_replace(F.concat(F.regexp_extract(base, "^([^:/?#]+)://", 1), F.lit("://"), urls.authority(href), urls.path(href)), "/+$", "")
    once = top(kept.withColumn("target", target), ["key", "target"], [F.col("pos")])
    return top(once, ["key"], [F.col("pos")], limit).select("key", "pos", F.col("target").alias("href"))


def host_of(url: str) -> str:
    return urlsplit(url).netloc
