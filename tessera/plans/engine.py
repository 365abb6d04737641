"""The flows as plans: prepare (enrich and verify leads), draft, discover, review. Every outside answer is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import contacts, drafts, fixed, icp, scores, text, urls
from tessera.operators import lookups, ranking
from tessera.plans import metrics
from tessera.sources import html


def site_facts(pages: DataFrame, most: int = 5) -> DataFrame:
    """(site, page, url, fact, source_type, confidence, place) from parsed pages (site, page, url, and the columns of a parsed page)."""
    of = lambda kind, items: F.transform(items, lambda t: F.struct(F.lit(kind).alias("source_type"), t.alias("raw")))
    parts = F.concat(of("meta", F.array("description")), of("title", F.array("title")), of("heading", F.col("headings")), of("jsonld", F.col("jsonld")), of("body", F.split("text", "\n")))
    rows = pages.filter("status = 'ok'").select("site", "page", "url", F.posexplode(parts).alias("part", "p"))
    said = rows.select("site", "page", "url", "part", "p.source_type", F.posexplode(text.sentences(F.col("p.raw"))).alias("n", "fact"))
    said = said.withColumn("fact", text.unrepeat(F.col("fact"))).filter(F.length("fact").between(35, 240) & ~F.col("fact").rlike(fixed.FACT_NOISE))
    order = [F.col("page"), F.col("part"), F.col("n")]
    once = ranking.top(said.withColumn("low", F.lower("fact")), ["site", "low"], order)
    confidence = F.greatest(F.lit(0.05), scores.fact_confidence(F.col("fact"), F.col("source_type"), F.col("page")) - urls.page_penalty(F.col("url")))
    placed = once.withColumn("confidence", confidence).withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("confidence"), *order)))
    return placed.filter(F.col("place") <= most).drop("low", "part", "n")


def enrich(sites: DataFrame, pages: DataFrame, max_pages: int = 4) -> DataFrame:
    """Sites (site) with status, summary, facts, sources, score and warnings, from captured pages (url, html)."""
    wanted = sites.select("site", F.posexplode(urls.candidate_pages(F.col("site"), fixed.SITE_PATHS, max_pages)).alias("page", "url"))
    bare = F.regexp_replace("url", "/+$", "")
    captured = wanted.withColumn("bare", bare).join(pages.select(bare.alias("bare"), "html"), "bare")
    parsed = html.parse_pages(captured, ["site", "page", "url"])
    facts = site_facts(parsed)
    ordered = F.array_sort(F.collect_list(F.struct("place", "fact", "url", "confidence")))
    found = facts.groupBy("site").agg(ordered.alias("f"))
    fetched = parsed.filter("status = 'ok'").groupBy("site").agg(F.count("*").alias("n_pages"))
    n, f = F.coalesce(F.size("f"), F.lit(0)), F.col("f")
    total = F.aggregate(f, F.lit(0.0), lambda a, x: a + x["confidence"])
    joined = sites.join(fetched, "site", "left").join(found, "site", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    score = scores.personalization(F.when(n > 0, total / n), n)
    status = F.when(F.col("site") == "", "missing").when(F.col("n_pages") == 0, "fetch_failed").otherwise("ok")
    pick = lambda c: F.transform(F.coalesce(f, F.array().cast("array<struct<place:int,fact:string,url:string,confidence:double>>")), lambda x: x[c])
    return joined.select(
        "site", status.alias("website_status"), F.coalesce(F.get(pick("fact"), 0), F.lit("")).alias("company_summary"), F.array_join(pick("fact"), " | ").alias("personalization_facts"),
        F.array_join(F.array_distinct(pick("url")), " | ").alias("source_urls"), score.cast("string").alias("personalization_score"), scores.enrichment_warnings(F.col("n_pages"), n, score).alias("quality_warnings"), F.to_json(F.struct(F.col("f").alias("facts"))).alias("enrichment_json"),
    )


def contact_pages(sites: DataFrame, pages: DataFrame, most: int = 5, paths: list[str] | None = None) -> DataFrame:
    """(site, page, url, and the columns of a parsed page) of the first ``most`` paths that may name people or addresses, as far as captured.

    Paths stand at the root of a site, wherever its address points; a site without a usable address has no pages.
    """
    base = urls.normalize_url(F.coalesce("site", F.lit("")))
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    asked = F.array(*(F.concat(origin, F.lit(p)) for p in (paths if paths is not None else fixed.CONTACT_PATHS)[:most]))
    wanted = sites.select("site").distinct().filter(origin != "").select("site", F.posexplode(asked).alias("page", "url"))
    bare = F.regexp_replace("url", "/+$", "")
    # both sides have a row for each path, which Spark's estimate of their size leaves out; neither may be broadcast
    captured = wanted.withColumn("bare", bare).hint("merge").join(pages.groupBy(bare.alias("bare")).agg(F.min("html").alias("html")), "bare")
    return html.parse_pages(captured, ["site", "page", "url"]).filter("status = 'ok'")


def prepare(leads: DataFrame, pages: DataFrame, mx: DataFrame, max_pages: int = 4) -> DataFrame:
    """Leads with their site's enrichment and the verification of their address; each site is read once."""
    keyed = leads.withColumn("site", urls.normalize_url(F.coalesce("website", F.lit(""))))
    sites = enrich(keyed.select("site").distinct(), pages, max_pages)
    verified = lookups.verify_emails(keyed.join(sites, "site", "left"), "email", mx)
    return verified.withColumn("verification_status", F.when(F.col("valid"), "valid").otherwise(F.col("reason"))).drop("site", "valid", "reason")


def draft(leads: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Leads with subject, text and warnings of the captured answers (key, raw); an answer that is missing is a row's error.

    Of several answers with one key the first by its text counts, an answer before a missing one.
    """
    subject, body = drafts.split_subject(F.col("raw"))
    joined = leads.join(responses.groupBy(key).agg(F.min("raw").alias("raw")), key, "left").withColumns({"generated_subject": drafts.clean_subject(subject), "generated_email": drafts.clean_body(body)})
    failed = F.col("raw").isNull()
    facts = F.coalesce("personalization_facts", F.lit("")) if "personalization_facts" in leads.columns else F.lit("")
    before = F.col("quality_warnings") if "quality_warnings" in leads.columns else F.lit("")
    warned = F.array_join(drafts.draft_warnings(F.col("generated_subject"), F.col("generated_email"), facts), " | ")
    out = joined.withColumn("quality_warnings", F.when(failed, drafts.merge_warnings(before, F.lit("generation_failed"))).otherwise(drafts.merge_warnings(before, warned)))
    return out.withColumn("generated_email", F.when(failed, "ERROR: no answer").otherwise(F.col("generated_email"))).withColumn("generated_subject", F.when(failed, "").otherwise(F.col("generated_subject"))).drop("raw")


def discover(candidates: DataFrame, pages: DataFrame, phrase: str, limit: int, conflict: Column | None = None, max_pages: int = 4, strong: list[str] | None = None, weak: list[str] | None = None, derived: dict[str, list[str]] | None = None) -> DataFrame:
    """Companies (company, website, domain, and optionally email, phone, region_fit, region_anchor, verdict, verdict_evidence) enriched, scored,
    classified, ranked. ``strong``, ``weak`` and ``derived`` are terms that speak for the phrase (``icp.supported``)."""
    keyed = candidates.withColumn("site", urls.normalize_url(F.col("website")))
    rows = keyed.join(enrich(keyed.select("site").distinct(), pages, max_pages), "site", "left").withColumn("place_of", F.lit(0))
    profile = icp.parse(phrase)
    said = F.concat_ws(" ", "company", "company_summary", "personalization_facts")
    found = icp.supported(said, profile, phrase, strong or [], weak or [], derived)
    rows = rows.withColumns({"icp_score": icp.score(F.col("website_status") == "ok", found, len(profile.tokens("core")), F.size(found["strong"]), F.size(found["weak"])), "matched_terms": F.array_join(F.array_distinct(F.concat(found["evidenced"], found["strong"], found["weak"])), " | "), "confirmed": found["confirmed"]})
    for c, default in (("email", ""), ("phone", ""), ("linkedin_company_url", ""), ("partnership_channel", ""), ("region_fit", 0), ("region_anchor", False), ("verdict", "unknown"), ("verdict_evidence", "")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(default))
    rows = rows.withColumn("email_type", F.when(F.col("email") != "", contacts.company_email_kind(F.col("email"))).otherwise(""))
    conflict = conflict if conflict is not None else F.lit(False)
    score, reasons = scores.company_lead(F.lit(True), conflict)
    level, why = scores.classify(conflict, urls.government(F.col("domain")), urls.aggregator(F.col("domain"), F.col("company_summary")), F.col("confirmed"), F.col("region_anchor"), F.coalesce("verdict", F.lit("unknown")), F.coalesce("verdict_evidence", F.lit("")))
    scored = rows.withColumns({"lead_score": score, "lead_score_reasons": reasons, "match_confidence": level, "verification": why})
    return ranking.banded_rank(scored, limit, "domain").drop("place_of", "confirmed", "verdict", "verdict_evidence")


def review(rows: DataFrame) -> DataFrame:
    """How often each warning occurs."""
    parts = F.filter(F.split(F.coalesce("quality_warnings", F.lit("")), r" \| "), lambda w: w != "")
    return rows.select(F.explode(parts).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


def draft_counts(drafts_: DataFrame) -> DataFrame:
    """One row: how many mails there are, and how many of them were written. As all counts, ``metrics`` has them without a further job."""
    return counted(drafts_, "drafts")


def company_counts(rows: DataFrame) -> DataFrame:
    """One row: how many companies have an address, a phone, a profile of their own."""
    return counted(rows, "companies")


def contact_counts(rows: DataFrame) -> DataFrame:
    """One row: how many leads have an address, and how many were found as profiles."""
    return counted(rows, "contacts")


def verification_counts(verified: DataFrame) -> DataFrame:
    """One row: valid and invalid addresses."""
    return counted(verified, "verified")


def counted(rows: DataFrame, kind: str) -> DataFrame:
    return rows.agg(*(c.alias(k) for k, c in metrics.figures(kind).items()))


def enriched(leads: DataFrame) -> bool:
    """Whether leads were prepared before; a table's columns tell."""
    return "personalization_facts" in leads.columns
