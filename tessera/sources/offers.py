"""What a company's pages offer for contact: addresses, numbers, profiles and partner pages, from their links and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import contacts, urls
from tessera.operators.ranking import top
from tessera.sources import html

# Hosts of profiles, and parts of paths that lead to partner pages.
SOCIAL = r"^https?://(?:[a-z0-9-]+\.)*(?:linkedin\.com|twitter\.com|x\.com|facebook\.com|instagram\.com|youtube\.com)(?:/|$)"
PARTNER = r"/(?:partners?|partnerships?|become-a-partner|resellers?|affiliates?)(?:/|$)"


def company_contacts(pages: DataFrame) -> DataFrame:
    """(site, emails, phones, socials, profile, partner_page) from pages (site, page, url, html); links first, the text only where they give none."""
    linked = html.links(pages.withColumn("k", F.struct("site", "page")), "k").select(F.col("key.site").alias("site"), F.col("key.page").alias("page"), "pos", "href")
    href = F.col("href")
    bare = F.substring_index(href, "?", 1)
    kind = F.when(href.startswith("mailto:"), "email").when(href.startswith("tel:"), "phone").when(href.rlike(r"linkedin\.com/company/"), "profile").when(href.rlike(SOCIAL), "social").when((urls.domain(href) == urls.domain(F.col("site"))) & F.lower(urls.path(href)).rlike(PARTNER), "partner")
    value = F.when(href.startswith("mailto:"), F.lower(F.substr(bare, F.lit(8)))).when(href.startswith("tel:"), F.substr(href, F.lit(5))).otherwise(bare)
    rows = linked.select("site", "page", "pos", kind.alias("kind"), value.alias("value"))
    once = top(rows, ["site", "kind", "value"], [F.col("page"), F.col("pos")]).filter("kind is not null and value <> ''")
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("page", "pos", "value")))), lambda x: x["value"])
    found = once.groupBy("site").agg(listed("email").alias("emails"), listed("phone").alias("phones"), listed("social").alias("socials"), listed("profile").alias("profiles"), listed("partner").alias("partners"))
    parsed = html.parse_pages(pages, ["site", "page"])
    written = parsed.groupBy("site").agg(F.array_sort(F.collect_set(F.struct("page", "text"))).alias("t"))
    said = F.array_distinct(F.flatten(F.transform("t", lambda x: F.transform(contacts.emails(x["text"]), F.lower))))
    own = F.filter(said, lambda e: urls.domain(contacts.email_host(e)) == urls.domain(F.col("site")))
    none = F.array().cast("array<string>")
    joined = written.join(found, "site", "left")
    emails = F.coalesce("emails", none)
    return joined.select("site", F.when(F.size(emails) > 0, emails).otherwise(own).alias("emails"), F.array_distinct(F.filter(F.transform(F.coalesce("phones", none), contacts.clean_phone), lambda p: p != "")).alias("phones"), F.coalesce("socials", none).alias("socials"), F.coalesce(F.get("profiles", 0), F.lit("")).alias("profile"), F.coalesce(F.get("partners", 0), F.lit("")).alias("partner_page"))
