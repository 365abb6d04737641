"""What a company's pages say of it for contact: structured data first, then links, and the text only where both are silent."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import contacts, urls
from tessera.functions.text import strip
from tessera.operators.people import COMPANY_PROFILE
from tessera.operators.ranking import top
from tessera.sources import html
from tessera.sources.offers import PARTNER, SOCIAL

# Parts of a postal address in the order in which they are written.
ADDRESS = ["streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry"]
ORG, LINK, TEXT = range(3)


def json_ld(pages: DataFrame, keep: list[str], of: str = "html") -> DataFrame:
    """The columns ``keep`` and ``raws``, the JSON-LD scripts of each page in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [html.read(page).jsonld for page in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(raws, pa.list_(pa.string()))], [*keep, "raws"])

    html.bound_batches(pages)
    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, of).mapInArrow(run, f"{kept}, raws array<string>")


def said(o: Column, path: str) -> Column:
    """A string in an object, stripped; null if there is none or it is something else."""
    return F.when(F.schema_of_variant(F.try_variant_get(o, path, "variant")) == "STRING", F.nullif(strip(F.try_variant_get(o, path, "string")), F.lit("")))


def address_of(o: Column) -> Column:
    """An address as one line: as written, or its parts in their order; of a part that is an object, its name."""
    parts = [F.coalesce(F.try_variant_get(o, f"$.address.{p}.name", "string"), F.when(~F.schema_of_variant(F.try_variant_get(o, f"$.address.{p}", "variant")).startswith("OBJECT"), F.try_variant_get(o, f"$.address.{p}", "string"))) for p in ADDRESS]
    whole = F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts))
    return F.coalesce(said(o, "$.address"), F.nullif(F.regexp_replace(whole, "^[, ]+|[, ]+$", ""), F.lit("")))


def organisations(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``at`` (the place among a page's objects), and name, email, telephone, address and same_as of each JSON-LD object.

    Scripts that are no JSON have no objects; lists and graphs are taken apart.
    """
    whole = F.try_parse_json("raw")
    listed = F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), F.array(whole))
    objects = F.flatten(F.transform(listed, lambda x: F.coalesce(F.try_variant_get(x, "$['@graph']", "array<variant>"), F.array(x))))
    rows = json_ld(pages, keep).select(*keep, F.posexplode("raws").alias("n", "raw")).filter(whole.isNotNull())
    each = rows.select(*keep, "n", F.posexplode(objects).alias("m", "o")).filter("o IS NOT NULL")
    o = F.col("o")
    email = said(o, "$.email")
    one = F.transform(F.array_compact(F.array(said(o, "$.sameAs"))), lambda s: s)
    many = F.transform(F.try_variant_get(o, "$.sameAs", "array<variant>"), lambda s: said(s, "$"))
    return each.select(
        *keep,
        F.struct("n", "m").alias("at"),
        said(o, "$.name").alias("name"),
        F.when(F.contains(email, F.lit("@")), strip(F.replace(email, F.lit("mailto:"), F.lit("")))).alias("email"),
        said(o, "$.telephone").alias("telephone"),
        address_of(o).alias("address"),
        F.coalesce(F.array_compact(many), one).alias("same_as"),
    )


def social(url: Column) -> Column:
    """A profile without what follows its question mark, a company's own cut to its name; null for other addresses."""
    own = F.nullif(F.regexp_extract(url, COMPANY_PROFILE, 1), F.lit(""))
    return F.coalesce(own, F.when(url.rlike(f"(?i){SOCIAL}"), F.substring_index(url, "?", 1)))


def contact_bundle(pages: DataFrame) -> DataFrame:
    """(site, name, address, emails, phones, socials, profile, partner_page) of pages (site, page, url, html).

    Of a page's objects the first value counts, of a site's pages the first one's; addresses, numbers and profiles are collected in the order of
    pages, structured data before links, each once. Addresses in the text count only on the first page that has one of the site's own domain,
    and only if no page up to it names one otherwise. Sites whose pages say nothing have empty values; repeated pages count once.
    """
    once = pages.groupBy("site", "page").agg(F.min("url").alias("url"), F.min("html").alias("html"))
    objects = organisations(once, ["site", "page"])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    by_page = objects.groupBy("site", "page").agg(*(first(c) for c in ("name", "email", "telephone", "address")), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "same_as"))), lambda x: x["same_as"])).alias("same_as"))
    find = lambda df, source, kind, pos, value: df.select("site", "page", F.lit(source).alias("source"), F.lit(kind).alias("kind"), pos.alias("pos"), value.alias("value"))
    zero, href = F.lit(0), F.col("href")
    linked = html.links(once.withColumn("k", F.struct("site", "page")), "k").select(F.col("key.site").alias("site"), F.col("key.page").alias("page"), "pos", "href")
    low = F.lower(href)
    mail, tel = low.startswith("mailto:"), low.startswith("tel:")
    own = urls.domain(href) == urls.domain(F.col("site"))
    texts = html.parse_pages(once, ["site", "page"]).select("site", "page", F.posexplode(contacts.emails(F.col("text"))).alias("pos", "e"))
    structured = find(by_page, ORG, "email", zero, F.lower("email")).union(find(linked.filter(mail), LINK, "email", F.col("pos"), F.lower(strip(F.substring_index(F.substring(href, 8, 1 << 30), "?", 1)))))
    structured = structured.filter(F.col("value").contains("@"))
    upto = structured.groupBy("site").agg(F.min("page").alias("_first"))
    plain = find(texts.filter(urls.domain(contacts.email_host(F.col("e"))) == urls.domain(F.col("site"))), TEXT, "email", F.col("pos"), F.lower("e")).join(upto, "site", "left").filter("_first IS NULL OR page < _first").drop("_first")
    plain = plain.join(plain.groupBy("site").agg(F.min("page").alias("page")), ["site", "page"], "left_semi").select(structured.columns)
    finds = structured.union(plain)
    finds = finds.union(find(by_page, ORG, "phone", zero, contacts.clean_phone(F.col("telephone")))).union(find(linked.filter(tel), LINK, "phone", F.col("pos"), contacts.clean_phone(F.substring(href, 5, 1 << 30))))
    same = by_page.select("site", "page", F.posexplode("same_as").alias("pos", "s"))
    finds = finds.union(find(same, ORG, "social", F.col("pos"), social(F.col("s")))).union(find(linked.filter(~mail & ~tel), LINK, "social", F.col("pos"), social(href)))
    finds = finds.union(find(linked.filter(own & F.lower(urls.path(href)).rlike(PARTNER)), LINK, "partner", F.col("pos"), F.substring_index(href, "#", 1)))
    finds = finds.union(find(by_page, ORG, "name", zero, F.col("name"))).union(find(by_page, ORG, "address", zero, F.col("address")))
    order = ["page", "source", "pos"]
    kept = top(finds.filter("value <> ''"), ["site", "kind", "value"], [F.col(c) for c in order])
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*order, "value")))), lambda x: x["value"])
    lists = kept.groupBy("site").agg(*(of(k).alias(f"_{k}") for k in ("name", "address", "email", "phone", "social", "partner")))
    none = F.array().cast("array<string>")
    out = pages.select("site").distinct().join(lists, "site", "left")
    head = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return out.select("site", head("_name").alias("name"), head("_address").alias("address"), F.coalesce("_email", none).alias("emails"), F.coalesce("_phone", none).alias("phones"), F.coalesce("_social", none).alias("socials"), head(F.filter("_social", lambda s: s.rlike(COMPANY_PROFILE))).alias("profile"), head("_partner").alias("partner_page"))
