"""Companies that source pages name: on the page itself, then on pages of the same site that may describe one company each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.operators.ranking import first_wins, top
from tessera.sources import html
from tessera.sources.scratch import held


def captured(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(k, url, html): the captured page of each wanted row (source, at, url), slashes at the end aside; of several the first by its text."""
    bare = F.regexp_replace("url", "/+$", "")
    joined = wanted.withColumn("_bare", bare).join(pages.select(bare.alias("_bare"), "html").filter("html IS NOT NULL"), "_bare")
    return joined.groupBy(F.struct("source", "at").alias("k"), "url").agg(F.min("html").alias("html"))


def from_sources(sources: DataFrame, pages: DataFrame, source_limit: int = 25) -> DataFrame:
    """(source, place, company, website, domain, discovery_source_url): at most ``source_limit`` companies of each source, each domain once.

    Companies on the page itself come first, in its order; only where they are too few are pages of the same site read that the page
    links to, at most twice ``source_limit`` of them (ten at least), in the order of their links. Pages that were not captured name
    nothing, and neither does a source without an address; sources that are repeated count once.
    """
    named = sources.filter(F.col("source").isNotNull()).select("source").distinct()
    first = named.select("source", F.lit(0).alias("at"), urls.normalize_url(F.col("source")).alias("url")).filter("url <> ''")
    found = held(html.links(captured(first, pages), "k"), "source-links")  # read three times, its pages parsed once
    own = html.candidates(found)
    full = own.groupBy(F.col("key.source").alias("source")).agg(F.count("*").alias("n")).filter(F.col("n") >= source_limit)
    near = html.detail_links(found, max(2 * source_limit, 10)).select("key.source", (F.col("pos") + 1).alias("at"), F.col("href").alias("url"))
    more = html.candidates(html.links(captured(near.join(full, "source", "left_anti"), pages), "k"))
    every = own.unionByName(more).select(F.col("key.source").alias("source"), F.col("key.at").alias("at"), "pos", "company", "website", "domain", "discovery_source_url")
    once = top(every, ["source", "domain"], [F.col("at"), F.col("pos")])
    numbered = once.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("at", "pos")))
    return numbered.filter(F.col("place") <= source_limit).select("source", "place", "company", "website", "domain", "discovery_source_url")


def pool_size(limit: int) -> int:
    """More than ``limit``, since some of the companies will be dropped later."""
    return max(5 * limit, limit + 20)


def pool(found: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """The companies of all sources (source, rank), each domain once: earlier sources win, then earlier places; ``pool_size(limit)`` rows at most."""
    ranks = sources.groupBy("source").agg(F.min("rank").alias("rank"))
    order = [F.col("rank"), F.col("source"), F.col("place")]
    return first_wins(found.join(ranks, "source"), "domain", order).orderBy(*order).limit(pool_size(limit)).drop("rank")
