"""Search results as a table: the cascade of engines, early stops, and the site that belongs to a company."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions import contacts, fixed, icp, urls
from tessera.functions.text import let, strip
from tessera.operators.ranking import top

ENGINES = ["ddgs", "brave", "serper", "ddg_html"]


def cascade(results: DataFrame, num: int = 10, engines: list[str] = ENGINES) -> DataFrame:
    """Per query, the first ``num`` results of the first engine that has any."""
    place = F.array_position(F.array(*(F.lit(e) for e in engines)), F.col("engine"))
    known = results.withColumn("_engine", place).filter("_engine > 0")
    best = F.min("_engine").over(Window.partitionBy("query"))
    return top(known.withColumn("_best", best).filter("_engine = _best"), ["query"], [F.col("rank"), F.col("url")], num).drop("_engine", "_best")


def first_productive(df: DataFrame, group: str, step: str) -> DataFrame:
    """Rows of each group's first step that gave any."""
    return df.withColumn("_first", F.min(step).over(Window.partitionBy(group))).filter(F.col(step) == F.col("_first")).drop("_first")


def credible(url: Column) -> Column:
    """An address that may be a company's own site."""
    fair = let(urls.domain(url), lambda dom: ~urls.blocked_domain(dom) & ~urls.directory(dom))
    return url.rlike("^https?://") & ~urls.blocked_host(urls.authority(url)) & fair


def resolve_websites(results: DataFrame, require_match: bool = False, country: str | None = None) -> DataFrame:
    """(company, website) from results (company, query_place, rank, url).

    The earliest credible domain that fits the company's name wins, one below ``country``'s top-level domain before all
    others; without a fit the earliest credible domain of the first productive query stands in unless a match is required.
    """
    seen = results.filter(credible(F.col("url"))).withColumn("domain", urls.domain(F.col("url")))
    fits = contacts.domain_fits_company(F.col("domain"), F.col("company"))
    local = F.col("domain").endswith(f".{country}") if country else F.lit(False)
    kind = F.when(fits & local, 0).when(fits, 1).otherwise(2)
    ranked = seen.withColumn("_kind", kind)
    if require_match:
        ranked = ranked.filter("_kind < 2")
    best = top(ranked, ["company"], [F.col("_kind"), F.col("query_place"), F.col("rank"), F.col("url")])
    return best.select("company", F.concat(F.lit("https://"), "domain").alias("website"))


def backfill_websites(leads: DataFrame, resolved: DataFrame) -> DataFrame:
    """Leads whose website is blank get that of their company, if one was found; companies are looked up once each.

    Of several websites of a company the first in order counts; a lead without a company finds none. No lead is repeated.
    """
    found = resolved.groupBy(F.trim("company").alias("_company")).agg(F.min("website").alias("_website"))
    own = F.nullif(F.trim(F.coalesce(F.col("website"), F.lit(""))), F.lit(""))
    joined = leads.join(found, F.trim("company") == F.col("_company"), "left")
    return joined.withColumn("website", F.coalesce(own, "_website", F.lit(""))).drop("_company", "_website")


def company_queries(companies: DataFrame) -> DataFrame:
    """(company, domain, place, query): all templates for each company."""
    places = F.posexplode(F.array(*(F.lit(t) for t in fixed.SEARCH_TEMPLATES))).alias("place", "template")
    filled = F.replace(F.replace("template", F.lit("{domain}"), F.col("domain")), F.lit("{company}"), F.col("company"))
    return companies.select("company", "domain", places).select("company", "domain", "place", filled.alias("query"))


def merge_pages(base: DataFrame, extra: DataFrame) -> DataFrame:
    """The base pages, and extra ones whose url, slashes at the end aside, is not among them."""
    bare = F.regexp_replace("url", "/+$", "")
    known = base.select("site", bare.alias("_url")).distinct()
    return base.unionByName(extra.withColumn("_url", bare).join(known, ["site", "_url"], "left_anti").drop("_url"), allowMissingColumns=True)


def own_page(url: Column, dom: Column) -> Column:
    """A page of the company's own site that may name people or ways to reach them: no file, no login, no legal text."""
    path = F.lower(urls.path(url))
    holds = lambda parts: F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(path, p))
    own = url.rlike("^https?://[^/?#]") & (urls.domain(url) == dom) & ~urls.blocked_host(urls.authority(url))
    return F.coalesce(own & holds(fixed.PAGE_HINTS) & ~holds(fixed.FILE_ENDS) & ~holds(fixed.PAGE_SKIPS), F.lit(False))


def company_page_urls(results: DataFrame, limit: int) -> DataFrame:
    """(company, domain, url, place): pages of the first productive query, each once, at most ``limit`` a company.

    ``results`` holds (company, domain, query_place, rank, url).
    """
    fit = results.filter(own_page(F.col("url"), F.col("domain")))
    bare = fit.withColumn("url", F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/+$", ""))
    once = top(first_productive(bare, "domain", "query_place"), ["domain", "url"], [F.col("rank"), F.col("company")])
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy("rank", "url")))
    return placed.filter(F.col("place") <= limit).select("company", "domain", "url", "place")


def core_phrases(phrases: pd.Series) -> pd.Series:
    """The core phrases of several words of target profiles."""
    return phrases.map(lambda p: [" ".join(chunk) for chunk in icp.parse(p or "").phrases])


def region_queries(profiles: DataFrame) -> DataFrame:
    """(phrase, region, place, query) for profiles (phrase, region): the templates, then each core phrase of several words in quotes.

    Null parts are empty in the queries; a profile that comes twice is asked once.
    """
    said, there = strip(F.col("phrase")), strip(F.col("region"))
    filled = []
    for template in fixed.REGION_TEMPLATES:
        parts = re.split(r"(\{icp\}|\{region\})", template)
        filled.append(F.concat(*({"{icp}": said, "{region}": there}.get(p, F.lit(p)) for p in parts)))
    quoted = F.transform("_core", lambda c: F.concat(F.lit('"'), c, F.lit('" '), there))
    cut = profiles.select("phrase", "region").distinct().withColumn("_core", F.pandas_udf(core_phrases, ArrayType(StringType()))(said))
    return cut.select("phrase", "region", F.posexplode(F.concat(F.array(*filled), quoted)).alias("place", "query"))


def expansion_queries(terms: DataFrame, lexicon: DataFrame, region: str, cap: int = 3) -> DataFrame:
    """(profile, place, query) for the first ``cap`` terms (profile, term) of each profile: those of the lexicon first, then by name."""
    known = lexicon.select("term").distinct().withColumn("_known", F.lit(0))
    wanted = terms.filter(F.coalesce("term", F.lit("")) != "").select("profile", "term").distinct().join(known, "term", "left")
    placed = wanted.withColumn("place", F.row_number().over(Window.partitionBy("profile").orderBy(F.coalesce("_known", F.lit(1)), "term")))
    made = placed.filter(F.col("place") <= cap).select("profile", "place", F.concat("term", F.lit(f" companies in {region.strip()}")).alias("query"))
    return made.filter(F.lit(bool(region.strip())))


def result_candidates(results: DataFrame) -> DataFrame:
    """Companies (company, website, domain, discovery_source_url, discovery_reason) from results (query, url, ...)."""
    dom = urls.domain(F.col("url"))
    made = results.filter(credible(F.col("url"))).withColumns({"domain": dom, "company": urls.company_from_domain(dom), "website": F.concat(F.lit("https://"), dom)})
    return made.withColumn("discovery_reason", F.concat(F.lit("search: "), "query")).withColumnRenamed("url", "discovery_source_url")


def discover_by_query(queries: DataFrame, results: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` companies that the queries (place, query) find, in the order of queries and ranks, each domain once."""
    found = result_candidates(cascade(results).join(queries.select("place", "query"), "query"))
    once = top(found, ["domain"], [F.col("place"), F.col("rank"), F.col("discovery_source_url")])
    return once.orderBy("place", "rank", "domain").limit(limit).select("company", "website", "domain", "discovery_source_url", "discovery_reason")
