"""Addresses, phones, person and company names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed, urls
from tessera.functions.text import let, squish, strip

EMAIL = r"(?i)([A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,})"
PERSON_LOCAL = r"^[a-z]+([._\-][a-z]+)?$"


def emails(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), 1)


def local_part(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", 1))


def email_host(email: Column) -> Column:
    return F.substr(email, F.locate("@", email) + 1)


def format_problem(email: Column) -> Column:
    """Null for a well-formed address."""
    e = strip(email)
    return F.when(e == "", "empty").when(~e.rlike(r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"), "invalid format")


def name_from_email(email: Column) -> Column:
    """The words of the local part, capitalised; nothing for role inboxes and numbers."""
    parts = F.filter(F.split(F.substring_index(email, "@", 1), r"[._+\-]+"), lambda p: (p != "") & ~p.rlike("^[0-9]+$"))
    spoken = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), " ")
    return F.when(local_part(email).isin(fixed.ROLE_PREFIXES), "").otherwise(spoken)


def ranked(local: Column, ranks: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), local)


def company_email_kind(email: Column) -> Column:
    local = local_part(email)
    role = local.isin(fixed.ROLE_PREFIXES) | local.isin(list(fixed.COMPANY_EMAIL_RANK))
    return F.when(role, "role_inbox").when(local.rlike(PERSON_LOCAL), "person_email").otherwise("company_email")


def company_email_rank(email: Column, dom: Column) -> Column:
    """How good an address is as a company's first touch; 35 less if it is not on the company's domain."""
    local, kind = local_part(email), company_email_kind(email)
    rank = F.when(kind == "role_inbox", F.coalesce(ranked(local, fixed.COMPANY_EMAIL_RANK), F.lit(45))).when(kind == "person_email", F.when(local.rlike("[._-]"), 98).otherwise(92)).otherwise(55)
    return rank - F.when(urls.domain(email_host(email)) == dom, 0).otherwise(35)


def people_email_rank(email: Column, source_url: Column) -> Column:
    local, where = local_part(email), F.lower(urls.path(source_url))
    person = F.when(local.rlike("[._-]"), 95).otherwise(88) + F.when(where.rlike("team|about|company"), 3).otherwise(0)
    return F.when(local.isin(fixed.ROLE_PREFIXES), F.coalesce(ranked(local, fixed.PEOPLE_EMAIL_RANK), F.lit(40))).when(local.rlike(PERSON_LOCAL), person).otherwise(50)


def email_patterns(first: Column, last: Column, dom: Column) -> Column:
    """Addresses that a name suggests; for inspection only, no plan uses them by itself."""
    f, s, at = F.substring(first, 1, 1), F.substring(last, 1, 1), F.concat(F.lit("@"), dom)
    dot = F.lit(".")
    locals_ = [(first, dot, last), (first,), (first, last), (f, last), (first, s), (f, dot, last), (last, dot, first), (first, F.lit("_"), last), (first, F.lit("-"), last)]
    return F.array(*(F.concat(*parts, at) for parts in locals_))


def clean_phone(raw: Column) -> Column:
    """Digits and plus signs of a number of 7 to 15 digits; year spans and doubled quads are none."""
    kept = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^0-9+]", "")
    digits = F.translate(kept, "+", "")
    a, b = F.substring(digits, 1, 4), F.substring(digits, 5, 4)
    year = lambda x: x.rlike("^(19|20)[0-9]{2}$")
    odd = ~kept.contains("+") & (F.length(digits) == 8) & ((a == b) | (year(a) & year(b)))
    return F.when(F.length(digits).between(7, 15) & ~odd, kept).otherwise("")


def valid_person(name: Column) -> Column:
    value = squish(name)
    parts = F.split(value, " ")
    fine = F.forall(parts, lambda p: p.rlike("^[A-Z][a-z]+$") & ~p.isin(fixed.BAD_PERSON_WORDS))
    return (F.length(value) <= 45) & (F.size(parts) >= 2) & fine & F.forall(F.slice(parts, 2, 100), lambda p: F.length(p) >= 3)


def bad_company_name(name: Column) -> Column:
    value = squish(name)
    return (value == "") | value.rlike(fixed.CALL_TO_ACTION) | value.rlike("^[0-9]+$") | (F.length(value) > 42)


def bare_company(name: Column) -> Column:
    """Lower case, without one legal form at the end."""
    return F.lower(strip(F.regexp_replace(F.coalesce(name, F.lit("")), fixed.LEGAL_SUFFIX, "")))


def company_tokens(name: Column) -> Column:
    return F.filter(F.split(bare_company(name), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def domain_fits_company(dom: Column, name: Column) -> Column:
    """The domain's first label and the name contain one another, or the label holds a token of four and more."""

    def compared(label: Column, tokens: Column) -> Column:
        compact = F.array_join(tokens, "")
        fits = F.contains(label, compact) | F.contains(compact, label) | F.exists(tokens, lambda t: (F.length(t) >= 4) & F.contains(label, t))
        return (F.size(tokens) > 0) & (label != "") & fits

    return let(F.struct(F.lower(urls.first_label(dom)).alias("label"), company_tokens(name).alias("tokens")), lambda x: compared(x["label"], x["tokens"]))


def same_company(candidate: Column, target: Column) -> Column:
    """Equal or contained names, or more than half of the words in common; short single words must stand alone."""
    c, t = bare_company(candidate), bare_company(target)
    cw, tw = F.array_distinct(F.split(c, r"\s+")), F.array_distinct(F.split(t, r"\s+"))
    overlap = F.size(F.array_intersect(cw, tw)) / F.greatest(F.size(cw), F.size(tw))
    alone = F.contains(t, c) | F.array_contains(F.split(c, "[^a-z0-9_]+"), t)
    short = ~t.contains(" ") & (F.length(t) <= 10)
    return (c != "") & (t != "") & ((c == t) | F.when(short, alone).otherwise(F.contains(t, c) | F.contains(c, t) | (overlap > 0.5)))


def slug_fits(url: Column, name: Column, dom: Column) -> Column:
    """The last part of a profile's url fits the domain's label, the compact name or a longer token."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    slug = bare(F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1))
    tokens = company_tokens(name)
    wanted = F.filter(F.concat(F.array(bare(urls.first_label(dom)), F.array_join(tokens, "")), F.filter(tokens, lambda t: F.length(t) >= 4)), lambda c: F.length(c) >= 3)
    return (F.length(slug) >= 3) & F.exists(wanted, lambda c: F.contains(slug, c) | F.contains(c, slug))


def display_name(name: Column, first: Column, last: Column) -> Column:
    given = lambda c: F.nullif(strip(c), F.lit(""))
    return F.coalesce(given(name), F.concat_ws(" ", given(first), given(last)))
