"""Scores, reasons and the classification of leads, as sums of conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.contacts import bad_company_name, local_part
from tessera.functions.text import join_present


def whole(c: Column) -> Column:
    """A number kept as text; 0 where it is none."""
    return F.coalesce(c.cast("string").try_cast("int"), F.lit(0))


def part(c: Column, by: int, most: int) -> Column:
    return F.least(F.floor(whole(c) / by).cast("int"), F.lit(most))


def points(condition: Column, yes: int, no: int = 0) -> Column:
    return F.when(condition, yes).otherwise(no)


def note(condition: Column, text: str) -> Column:
    return F.when(condition, text)


def given(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(c, F.lit(100))).cast("int")


def people_lead() -> tuple[Column, Column]:
    """Score and reasons of a row with the columns of the people table."""
    c = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("company", "discovery_reason", "company_summary", "personalization_facts", "icp_score", "matched_terms", "personalization_score", "contact_type", "contact_score", "contact_confidence", "website_status")}
    facts = F.concat_ws(" ", c["discovery_reason"], c["company_summary"], c["personalization_facts"])
    contact = F.when(given(c["contact_score"]), c["contact_score"]).otherwise(c["contact_confidence"])
    bad, signal, noisy, ok = bad_company_name(c["company"]), facts.rlike(fixed.B2B_SIGNAL), facts.rlike(fixed.NOISY_PRODUCT), c["website_status"] == "ok"
    score = 35 + points(bad, -20, 8) + part(c["icp_score"], 4, 20) + part(c["personalization_score"], 5, 18) + part(contact, 5, 18) + points(signal, 12) - points(noisy, 25) - points(~ok, 15)
    reasons = [note(bad, "weak_company_name"), note(~bad, "clean_company_name"), note(given(c["matched_terms"]), "icp_match"), note(whole(c["personalization_score"]) >= 75, "strong_enrichment"), F.nullif(c["contact_type"], F.lit("")), note(signal, "b2b_signal"), note(noisy, "noisy_product"), note(~ok, "website_failed")]
    return clamp(score), join_present(*reasons)


def company_lead(region_targeted: Column, region_conflict: Column) -> tuple[Column, Column]:
    """Score and reasons of a row with the columns of the company table."""
    c = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("website_status", "icp_score", "matched_terms", "personalization_score", "email_type", "phone", "linkedin_company_url", "partnership_channel", "region_fit", "company_summary", "personalization_facts")}
    ok, region, kind = c["website_status"] == "ok", whole(c["region_fit"]), c["email_type"]
    unsure = ~region_conflict & region_targeted & (region == 0)
    signal = F.concat_ws(" ", c["company_summary"], c["personalization_facts"]).rlike(fixed.B2B_SIGNAL)
    by_kind = F.when(kind == "person_email", 18).when(kind == "role_inbox", 12).when(kind == "company_email", 8).otherwise(0)
    score = 30 + points(ok, 10, -15) + part(c["icp_score"], 4, 20) + part(c["personalization_score"], 6, 15) + by_kind + points(given(c["phone"]), 5) + points(given(c["linkedin_company_url"]), 6) + points(given(c["partnership_channel"]), 8) + part(c["region_fit"], 5, 18) - points(region_conflict, 30) - points(unsure, 15) + points(signal, 6)
    reasons = [note(ok, "site_ok"), note(~ok, "site_failed"), note(given(c["matched_terms"]), "icp_match"), F.when(kind.isin("person_email", "role_inbox", "company_email"), kind), note(given(c["phone"]), "phone"), note(given(c["linkedin_company_url"]), "linkedin_company"), note(given(c["partnership_channel"]), "partnership_channel"), note(region >= 40, "region_fit"), note(region_conflict, "region_conflict"), note(unsure, "region_unconfirmed"), note(signal, "b2b_signal")]
    return clamp(score), join_present(*reasons)


def contact(kind: Column, role: Column, email: Column, name: Column, confidence: Column) -> tuple[Column, Column]:
    """How useful a contact is, and why."""
    role, local = F.coalesce(role, F.lit("")), local_part(F.coalesce(email, F.lit("")))
    relevant, executive = role.rlike(fixed.RELEVANT_ROLE), role.rlike(fixed.EXEC_ROLE)
    high, low = local.isin(fixed.HIGH_VALUE_PREFIXES), local.isin(fixed.LOW_VALUE_PREFIXES)
    is_ = lambda k: kind == k
    base = (
        F.when(is_("public_email"), 72 + points(given(name), 10))
        .when(is_("role_inbox"), F.when(high, 74).when(low, 44).otherwise(50))
        .when(is_("linkedin_profile"), points(relevant, 68, 55))
        .when(is_("public_person"), F.when(relevant, 58).when(executive, 30).otherwise(40))
        .when(is_("contact_page"), 28)
        .when(is_("role_guess"), 18)
        .otherwise(0)
    )
    first = (
        F.when(is_("public_email"), "person_email")
        .when(is_("role_inbox"), F.when(high, "relevant_role_inbox").when(low, "generic_role_inbox").otherwise("role_inbox"))
        .when(is_("linkedin_profile"), F.when(relevant, "linkedin_relevant_role").otherwise("linkedin_profile"))
        .when(is_("public_person"), F.when(relevant, "relevant_public_person").when(executive, "exec_public_person").otherwise("public_person"))
        .when(is_("contact_page"), "contact_page")
        .when(is_("role_guess"), "guessed_role_email")
    )
    alone = executive & ~is_("public_email")
    score = base + part(confidence, 10, 10) + points(relevant, 12) - points(alone, 10)
    return clamp(score), join_present(first, note(is_("public_email") & given(name), "name_from_email"), note(relevant, "role_relevance"), note(alone, "exec_only"))


def fact_confidence(text: Column, source_type: Column, page: Column) -> Column:
    """Between 0.05 and 0.95, before the penalty of the page; summed in this order, as doubles."""
    low = F.lower(text)
    score = F.lit(0.25) + F.when(source_type.isin("meta", "jsonld"), 0.35).when(source_type == "heading", 0.25).otherwise(0.0)
    score = score + F.when(text.rlike(fixed.FACT_VERBS), 0.25).otherwise(0.0) + F.when(F.length(text).between(45, 180), 0.1).otherwise(0.0)
    score = score + F.when(page == 0, 0.05).otherwise(0.0) - F.when(low.rlike("pricing|free|upgrade"), 0.2).otherwise(0.0)
    return F.least(score, F.lit(0.95))


def personalization(average: Column, n: Column) -> Column:
    """70 times the mean confidence and 8 a fact up to 30, rounded half to even; 0 without facts."""
    return F.when(n > 0, F.least(F.lit(100), F.bround(average * 70 + F.least(8 * n, F.lit(30)), 0)).cast("int")).otherwise(0)


def enrichment_warnings(n_pages: Column, n_facts: Column, score: Column) -> Column:
    return join_present(note(n_pages == 0, "website_fetch_failed"), F.when(n_facts == 0, "no_grounded_facts").when(score < 55, "low_personalization_confidence"))


def size_tier(text: Column) -> Column:
    """By the number of employees that the text states, all its digits read as one number; else by words for small firms."""
    said = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b([0-9][0-9.,  ]*)\+?\s*(?:employees|staff|people|team members)\b", 1)
    n = F.regexp_replace(said, "[^0-9]", "").try_cast("bigint")
    small = F.coalesce(text, F.lit("")).rlike(r"(?i)\b(?:family[- ]owned|family business|small team|boutique|small business)\b")
    return F.when(n >= 1000, "enterprise").when(n >= 200, "mid").when(n >= 20, "sme").when(n.isNotNull(), "micro").when(small, "sme").otherwise("")


def classify(conflict: Column, is_government: Column, is_aggregator: Column, evidence: Column, region_anchor: Column, verdict: Column, detail: Column) -> tuple[Column, Column]:
    """Confidence and its reason; ``verdict`` is yes, no or unknown, ``detail`` what a no rests on."""
    verdict = F.coalesce(verdict, F.lit("unknown"))
    industry = evidence | (verdict == "yes")
    ok = industry & region_anchor
    level = F.when(conflict | is_government | (verdict == "no"), "rejected").when(is_aggregator, "review").when(ok, "verified").otherwise("review")
    reason = (
        F.when(conflict, "region_conflict")
        .when(is_government, "government_site")
        .when(verdict == "no", F.concat(F.lit("llm_mismatch:"), F.coalesce(F.nullif(detail, F.lit("")), F.lit("different company"))))
        .when(is_aggregator, "marketplace_directory")
        .when(ok, F.concat(F.lit("icp+region_confirmed"), F.when(verdict == "yes", "+llm").otherwise("")))
        .when(~industry, "icp_unconfirmed")
        .otherwise("region_unconfirmed")
    )
    return level, reason
