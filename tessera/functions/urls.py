"""URLs, hosts, registrable domains and the company names they suggest."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.text import let, squish, strip, title


def normalize_url(c: Column) -> Column:
    """With a scheme, without slashes at the end; empty if nothing is left of the host."""
    trimmed = strip(c)
    full = F.when(trimmed.rlike("^https?://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    return F.when(full.rlike("^https?://[/?#]*$"), "").otherwise(F.regexp_replace(full, "/+$", ""))


def authority(c: Column) -> Column:
    """What stands between ``://`` and the path, as written."""
    full = F.when(c.contains("://"), c).otherwise(F.concat(F.lit("https://"), c))
    return F.regexp_extract(full, "^[^:]*://([^/?#]*)", 1)


def path(c: Column) -> Column:
    return F.regexp_extract(c, "^[^:]*://[^/?#]*([^?#]*)", 1)


def registrable(host: Column) -> Column:
    """The last two labels; three where the second last is a public one below a country code."""
    low = F.regexp_replace(F.regexp_replace(F.lower(host), r"^\.+|\.+$", ""), r"^www\.", "")

    def last(labels: Column) -> Column:
        n = F.size(labels)
        public = (n >= 3) & F.try_element_at(labels, F.lit(-2)).isin(fixed.SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
        take = F.when(public, 3).otherwise(F.least(n, F.lit(2)))
        return F.array_join(F.slice(labels, n - take + 1, take), ".")

    return let(F.split(low, r"\."), last)


def domain(c: Column) -> Column:
    return registrable(authority(c))


def first_label(dom: Column) -> Column:
    return F.substring_index(dom, ".", 1)


def company_from_domain(dom: Column) -> Column:
    return title(F.translate(first_label(dom), "-_", "  "))


def company_from_anchor(text: Column, dom: Column) -> Column:
    """The link's own words, unless they only invite a click, are too short or long, or are a url."""
    said = squish(text)
    named = F.length(said).between(2, 60) & ~said.rlike(fixed.CALL_TO_ACTION) & ~F.lower(said).rlike(r"^(http|www\.)")
    return F.when(named, said).otherwise(company_from_domain(dom))


def below(dom: Column, domains: list[str]) -> Column:
    """One of the domains, or a subdomain of one."""
    return dom.rlike(rf"(^|\.)({'|'.join(map(re.escape, domains))})\z")  # one pattern: an expression inside a lambda is computed for each item


def blocked_domain(dom: Column, source: Column | None = None) -> Column:
    own = F.lit(False) if source is None else dom == source
    return (dom == "") | own | below(dom, fixed.BLOCKED_DOMAINS)


def blocked_host(host: Column) -> Column:
    """Holds one of the parts anywhere; part of the published behaviour, so ``therapi.`` is blocked as well."""
    return F.lower(host).rlike("|".join(map(re.escape, fixed.BLOCKED_HOST_PARTS)))


def directory(dom: Column) -> Column:
    return below(dom, fixed.DIRECTORY_DOMAINS)


def aggregator(dom: Column, summary: Column) -> Column:
    return first_label(F.lower(dom)).isin(fixed.AGGREGATOR_STEMS) | F.coalesce(summary, F.lit("")).rlike(rf"(?i)\b{fixed.AGGREGATOR_PHRASES}\b")


def government(dom: Column) -> Column:
    low = F.lower(dom)
    return low.rlike(r"\.(gov|mil)$") | low.rlike(r"\.(gov|govt|go|mil)\.[^.]{2}$")


def page_penalty(url: Column) -> Column:
    p = F.lower(path(url))
    return F.when(p.contains("pricing"), 0.25).when(p.contains("careers") | p.contains("blog"), 0.1).otherwise(0.0)


def candidate_pages(url: Column, paths: list[str], most: int) -> Column:
    """The pages of a site that are worth reading, at most ``most``, in the order of ``paths``."""
    origin = F.regexp_extract(normalize_url(url), "^(https?://[^/?#]*)", 1)
    return F.slice(F.array_distinct(F.array(*(F.concat(origin, F.lit(p)) for p in paths))), 1, most)
