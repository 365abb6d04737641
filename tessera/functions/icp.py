"""Target profiles: a phrase becomes chunks on the driver, and evidence for it is a set of columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.text import stem, stems, words


@dataclass(frozen=True)
class Profile:
    """Core phrases in order, required core tokens, and qualifier tokens."""

    chunks: tuple[tuple[str, tuple[str, ...]], ...]

    def tokens(self, role: str) -> list[str]:
        """Required tokens of the role's chunks, in order, each once."""
        return list(dict.fromkeys(t for r, chunk in self.chunks if r == role for t in required(chunk)))

    @property
    def phrases(self) -> list[tuple[str, ...]]:
        return [chunk for role, chunk in self.chunks if role == "core" and len(chunk) > 1 and required(chunk)]


def required(chunk: tuple[str, ...]) -> list[str]:
    return [t for t in chunk if t not in fixed.GENERIC_TERMS and t not in fixed.STOPWORDS]


def parse(phrase: str) -> Profile:
    """Cut at linkers and qualifier markers; what follows the first marker qualifies and is not core."""
    tokens = [t.lower() for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9\-&]*", phrase or "") if len(t) > 1]
    marks = [i for i, t in enumerate(tokens) if t in fixed.QUALIFIER_MARKERS]
    turn = marks[0] if marks else len(tokens)
    chunks: list[tuple[str, tuple[str, ...]]] = []
    for role, part in (("core", tokens[:turn]), ("qualifier", tokens[turn:])):
        cuts = [-1, *(i for i, t in enumerate(part) if t in fixed.CORE_LINKERS + fixed.QUALIFIER_MARKERS), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if chunk := tuple(t for t in part[a + 1 : b] if t not in fixed.TRANSPARENT):
                chunks.append((role, chunk))
    return Profile(tuple(chunks))


def _stem(word: str) -> str:
    m = re.fullmatch("(.{4,}?)(?:ings|ing|ers|er|ed|es|s)", word.lower())
    w = m[1] if m else word.lower()
    return w[:-1] if len(w) >= 5 and w.endswith("e") else w


def phrase_hit(text: Column, chunk: tuple[str, ...]) -> Column:
    """The chunk's stems in order with at most two words between neighbours, or written as one word."""
    whole = "".join(t.replace("-", "") for t in chunk)
    found = stems(text)
    line = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
    targets = [_stem(t.replace("-", "")) for t in chunk]
    # every gap ends at the nearest match, so a target may not stand inside the gap before it
    pattern = f" {targets[0]}" + "".join(rf" (?:(?!{t} )[a-z0-9]+ ){{0,2}}{t}(?= )" for t in targets[1:]) + "(?= )"
    return line.rlike(pattern) | F.arrays_overlap(found, F.array(F.lit(whole), F.lit(_stem(whole))))


def token_evidenced(text: Column, token: str, derived: list[str] | None = None) -> Column:
    """Its own stem, itself inside the text from three letters on, its singular, or a term derived from it."""
    found, low = stems(text), F.lower(F.coalesce(text, F.lit("")))
    said = F.array_contains(found, _stem(token))
    if len(token) >= 3:
        said = said | low.contains(token)
        if token.endswith("s"):
            said = said | F.array_contains(words(text), token[:-1])
    for term in derived or []:
        said = said | F.array_contains(found, _stem(term))
        if len(term) >= 4:
            said = said | low.contains(term)
    return said


def evidence(text: Column, profile: Profile, derived: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Columns: phrases (how many hit), evidenced (core tokens), qualifiers (tokens), confirmed (all core tokens)."""
    derived = derived or {}
    hits = {chunk: phrase_hit(text, chunk) for chunk in profile.phrases}
    core = profile.tokens("core")

    def shown(token: str) -> Column:
        by_phrase = [hit for chunk, hit in hits.items() if token in required(chunk)]
        own = token_evidenced(text, token, derived.get(token))
        for hit in by_phrase:
            own = own | hit
        return own

    some = F.array_compact(F.array(*(F.when(shown(t), t) for t in core))) if core else F.array().cast("array<string>")
    qualifiers = profile.tokens("qualifier")
    also = F.array_compact(F.array(*(F.when(token_evidenced(text, t, derived.get(t)), t) for t in qualifiers))) if qualifiers else F.array().cast("array<string>")
    phrases = F.lit(0)
    for hit in hits.values():
        phrases = phrases + F.when(hit, 1).otherwise(0)
    return {"phrases": phrases, "evidenced": some, "qualifiers": also, "confirmed": (F.size(some) == len(core)) & F.lit(bool(core))}


def score(site_ok: Column, found: dict[str, Column], n_required: int, strong: Column, weak: Column) -> Column:
    """35 or 15, and at most 50 for phrases, tokens, qualifiers and expansion terms."""
    tokens = F.when(found["confirmed"], 14 * n_required).otherwise(7 * F.size(found["evidenced"]))
    bonus = 18 * found["phrases"] + tokens + 14 * strong + 7 * F.size(found["qualifiers"]) + 7 * weak
    return (F.when(site_ok, 35).otherwise(15) + F.least(bonus, F.lit(50))).cast("int")


def matched_terms(text: Column, terms: list[str]) -> Column:
    """The terms whose stem is in the text, or which are inside it from four letters on, sorted."""
    found, low = stems(text), F.lower(F.coalesce(text, F.lit("")))
    return F.sort_array(F.array_compact(F.array(*(F.when(F.array_contains(found, _stem(t)) | (F.lit(len(t) >= 4) & low.contains(t)), t) for t in terms))))


def stem_column(c: Column) -> Column:
    return stem(c)


def own_terms(phrase: str) -> list[str]:
    """Words of three letters and more of the phrase that are neither stop words nor generic, in lower case, sorted."""
    found = (t.lower() for t in re.findall(r"[a-zA-Z0-9][a-zA-Z0-9\-]{2,}", phrase or ""))
    return sorted({t for t in found if t not in fixed.STOPWORDS and t not in fixed.GENERIC_TERMS})


def supported(text: Column, profile: Profile, phrase: str, strong: list[str], weak: list[str], derived: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """``evidence`` with terms of other languages (strong) and related ones (weak); strong and weak hold the matched terms.

    A core of one required token is confirmed by one strong term or two weak ones as well; a longer one only by its own tokens.
    """
    found = evidence(text, profile, derived)
    core = profile.tokens("core")
    own = set(core) | set(profile.tokens("qualifier")) | set(own_terms(phrase))
    terms = lambda given: matched_terms(text, given) if given else F.array().cast("array<string>")
    by_strong, by_weak = terms(sorted(set(strong))), terms(sorted(set(weak) - set(strong) - own))
    also = (F.size(by_strong) > 0) | (F.size(by_weak) >= 2) if len(core) < 2 else F.lit(False)
    return found | {"confirmed": found["confirmed"] | also, "strong": by_strong, "weak": by_weak}
