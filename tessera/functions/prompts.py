"""What a model is asked to write, as columns. The wording is this library's own; the parts and when they appear are the contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.drafts import structure

#: How a mail may be built; each recipient gets one of five by the md5 of the address.
STRUCTURES = ["Start with a detail about them.", "Start with a question.", "Start with what the sender noticed.", "Start with the result the sender offers.", "Start with something both have in common."]
RULES = "First line: a subject of two to six words. Then an empty line, then three short paragraphs, 80 words at most. Plain text only, nothing before or after the mail."
SHORT_RULES = "Write only the body: three short paragraphs, 80 words at most, plain text."


def recipient() -> Column:
    """The name, or first and last name."""
    whole = text.strip(F.concat_ws(" ", "first_name", "last_name"))
    return F.coalesce(F.nullif(F.col("name"), F.lit("")), whole)


def readable(c: Column, longest: int = 4000) -> Column:
    """The text if it can be used, without more than the model needs; else null."""
    return F.when(text.usable(c), F.substring(text.strip(c), 1, longest))


def given(label: str, value: str | None) -> Column:
    return F.lit(f"{label}: {value}" if value else None).cast("string")


def user_prompt(identity: dict, profile: dict, campaign: dict, facts: Column, website: Column) -> Column:
    """Lines: whom to write to, who writes, what for, what is known of the company, the structure, the rules.

    Facts come before the website's text, and without both the model is told to use what it knows. The campaign's own
    description and pitch come before the profile's.
    """
    facts, site = readable(facts), readable(website)
    known = F.when(facts.isNotNull(), F.concat(F.lit("Facts:\n"), facts, F.lit("\nUse one of these facts and claim nothing else; without a fitting one keep it simple.")))
    known = known.when(site.isNotNull(), F.concat(F.lit("Their website:\n"), site, F.lit("\nRefer to what they do there.")))
    known = known.otherwise(F.concat(F.lit("Use what you know about "), F.col("company"), F.lit(".")))
    built = F.element_at(F.array(*(F.lit(s) for s in STRUCTURES)), structure(F.col("email")) + 1)
    whom = F.format_string("Write a first mail from %s to %s at %s (%s).", F.lit(identity.get("name") or "the sender"), recipient(), F.col("company"), F.col("email"))
    return F.concat_ws(
        "\n", whom, given("Sender's role", profile.get("role")), given("Sender's company", profile.get("company")),
        given("About the sender", campaign.get("description") or profile.get("bio")), given("Message", campaign.get("pitch") or profile.get("pitch")), known, built, F.lit(RULES),
    )


def template_prompt(identity: dict) -> Column:
    """The short form for campaigns that say too little of themselves."""
    return F.format_string("Write a first mail from %s to %s at %s, with what you know about the company. %s", F.lit(identity.get("name") or "[Your Name]"), recipient(), F.col("company"), F.lit(SHORT_RULES))


def has_context(campaign: dict) -> bool:
    return bool(campaign.get("description") and campaign.get("pitch"))


def lead_prompt(identity: dict, profile: dict, campaign: dict, facts: Column, website: Column, enriched: bool) -> Column:
    """The whole prompt where the campaign or the leads' enrichment give something to write about, else the short one."""
    return user_prompt(identity, profile, campaign, facts, website) if enriched or has_context(campaign) else template_prompt(identity)
