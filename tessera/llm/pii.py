"""Personal data with exact source offsets, disguised forms included.

Plain identifiers (email, ip, card, phone) are found by their patterns in the source itself. Then transducers
rewrite the text piece by piece, keeping for every character of the result the span of the source it came from:

* look-alike letters and digits (full width, mathematical, Cyrillic, Greek) become ASCII, invisible ones vanish;
* runs of spelled digits ("four one nine") become digits, "plus" before and "dot" or "point" between them likewise;
* "(at)", "[at]", " at " and "(dot)", "[dot]", " dot " become "@" and "." where an address can stand.

The same patterns run over the result, and every find that touches rewritten text is mapped back to the source, unless it lies
within a plain find of its kind; one that reaches beyond a plain find is added beside it. A bare " at " counts only if the domain after it is written with a disguised dot, so that prose is left alone.

Defined cases: a null text is an empty text; an empty text has no spans; repeated rows and ids are judged row by
row; an empty table gives an empty table; other columns are left out; a text of any length is read whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

KINDS = ("email", "ip", "card", "phone")
# All places where a number may be: a digit or plus, then what the number patterns can hold.
ZONE = re.compile(r"[0-9+][0-9 .()+-]*")
# Possessive and anchored at the start of a digit run, which finds the same as the plain pattern in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Digit words by language, and letters that look like ASCII ones.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ɑ": "a", "ı": "i",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "З": "3", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "．": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "＠": "@", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
# Characters that the first transducer rewrites: the tables above, full-width forms, mathematical letters and digits.
ODD = re.compile(f"[{re.escape(''.join(LOOKALIKES))}{INVISIBLE}！-～⁰-₉²³¹①-⑨\U0001d400-\U0001d7ff]")
DIGITS = {w: str(i) for words in DIGIT_WORDS.values() for i, w in enumerate(words.split())} | {"oh": "0"}
WORD = "|".join(sorted((w for w in DIGITS), key=len, reverse=True))
# Three digit words or digits at least; "dot" and "point" only between digits, "plus" only before.
SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[ -]+)?(?:{WORD})(?:[ ,-]+(?:(?:dot|point)[ ,-]+)?(?:{WORD}|[0-9]+)){{2,}}(?!\w)")
SPELLED_PART = re.compile(rf"(?i)plus|dot|point|{WORD}|[0-9]+")
# Cheap tests of the lower-cased text: the second and third word of a spelled run; a boxed sign or a bare " dot ".
HINT = re.compile(rf"[ ,-](?:{WORD})[ ,-]+(?:(?:dot|point)[ ,-]+)?(?:{WORD}|[0-9])")
DOT = r"\s*[\[({{<]\s*(?:dot|\.)\s*[\])}}>]\s*".format()
NAME, LABEL = r"[A-Za-z0-9_%+-]+", r"[A-Za-z0-9-]+"
# An address with any disguise is found from its sign: the domain after it, and before it, in the text turned round, its local part;
# both may be dotted plainly or in disguise. A boxed sign takes the white space around it.
SIGN = re.compile(r"(?i)[\[({<]\s*(?:at|@)\s*[\])}>]| at |@")
AFTER = re.compile(rf"(?i)\s*({LABEL}(?:(?:\.|{DOT}| dot ){LABEL})+)")
TURNED_DOT = r"\s*[\])}>]\s*(?:tod|\.)\s*[\[({<]\s*"
BEFORE = re.compile(rf"(?i)\s*({NAME}(?:(?:\.|{TURNED_DOT}| tod ){NAME})*)")
BOX = re.compile(r"[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]")
IN_ADDRESS_DOT = re.compile(rf"(?i){DOT}| dot ")


def luhn(digits: str) -> bool:
    back = [int(d) for d in digits[::-1]]
    return (sum(back[0::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def plain(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four patterns in the text, ordered by start and kind."""
    found: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        # the local part is what stands directly before the sign, as far back as the last find allows
        start = at
        while start > free and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for zone in ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        part = zone[0]
        if part.count(".") >= 3:
            found += [("ip", a + m.start(), a + m.end()) for m in IP.finditer(part) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        if b - a >= 14:
            for m in CARD.finditer(part):
                digits = NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", a + m.start(), a + m.end()))
        if "+" in part:
            for m in PHONE.finditer(part):
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", a + m.start(), a + m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Mapped:
    """A rewritten text and, for each of its characters, the span of the source; ``changed`` marks rewritten ones."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the spans, which are in order and apart; each new character stands for the whole span it replaces."""
        texts, starts, ends, marks, at = [], [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            marks += [self.changed[at:a], np.ones(len(new), bool)]
            at = b
        self.text = "".join([*texts, self.text[at:]])
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])
        self.changed = np.concatenate([*marks, self.changed[at:]])


def ascii_form(char: str) -> str:
    if char in INVISIBLE:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    plain_form = unicodedata.normalize("NFKC", char)
    return plain_form if plain_form.isascii() else LOOKALIKES.get(plain_form, char)


def lookalike_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), new) for m in ODD.finditer(text) if (new := ascii_form(m[0])) != m[0]]


def spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in SPELLED.finditer(text):
        # each word becomes its digit; the separators between two words vanish
        parts = list(SPELLED_PART.finditer(text, m.start(), m.end()))
        for p, following in zip(parts, [*parts[1:], None], strict=True):
            w = p[0].lower()
            new = DIGITS.get(w) or {"plus": "+", "dot": ".", "point": "."}.get(w, w)
            edits.append((p.start(), p.end(), new))
            if following:
                edits.append((p.end(), following.start(), ""))
    return edits


def address_edits(text: str) -> list[tuple[int, int, str]]:
    edits, turned, free = [], None, 0
    for sign in SIGN.finditer(text):
        a, b = sign.span()
        if a < free:
            continue
        plain_sign, boxed_sign = sign[0] == "@", sign[0][0] in "[({<"
        domain = AFTER.match(text, b)
        if not domain or (domain.start(1) > b and not boxed_sign):
            continue
        turned = turned if turned is not None else text[::-1]
        local = BEFORE.match(turned, len(text) - a, len(text) - free)
        if not local or (local.start(1) > len(text) - a and not boxed_sign):
            continue
        free = domain.end(1)
        dots = list(IN_ADDRESS_DOT.finditer(text, domain.start(1), domain.end(1)))
        first, last = len(text) - local.end(1), len(text) - local.start(1)
        inner = list(IN_ADDRESS_DOT.finditer(text, first, last))
        if not plain_sign and not boxed_sign and not dots or plain_sign and not dots + inner:
            continue
        edits += [(d.start(), d.end(), ".") for d in inner]
        if not plain_sign:
            edits.append((last, domain.start(1), "@"))
        edits += [(d.start(), d.end(), ".") for d in dots]
    return edits


def odd(text: str) -> bool:
    return not text.isascii() and bool(ODD.search(text))


def spelled(text: str) -> bool:
    return bool(HINT.search(text.lower()))


def boxed(text: str) -> bool:
    low = text.lower()
    return " dot " in low or bool(BOX.search(low))


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The plain spans, and those that only the rewritten text shows, both in the source's offsets."""
    base = plain(text)
    mapped = None
    for hinted, edits_of in ((odd, lookalike_edits), (spelled, spelled_edits), (boxed, address_edits)):
        now = mapped.text if mapped else text
        if not hinted(now) or not (edits := edits_of(now)):
            continue
        mapped = mapped or Mapped(text)
        mapped.rewrite(edits)
    if mapped is None:
        return base, []
    taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    added = []
    # where characters vanished, the neighbours touch rewritten text as well
    gaps = np.zeros(len(mapped.text), bool)
    if len(gaps) > 1:
        gaps[1:] = mapped.start[1:] > mapped.end[:-1]
    touched = np.concatenate([[0], np.cumsum(mapped.changed | gaps)])
    for kind, a, b in plain(mapped.text):
        if touched[b] == touched[a]:
            continue
        start, end = int(mapped.start[a]), int(mapped.end[b - 1])
        if not any(x <= start and end <= y for x, y in taken[kind]):
            added.append((kind, start, end))  # what only widens a plain find stands beside it
    return base, added


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans array<struct<kind, start, end, added>>) in the order of their starts, as code points of the text."""
    common.small_batches(df.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = all_spans(text or "")
                spans = [(*s, False) for s in base] + [(*s, True) for s in added]
                rows.append([dict(zip(("kind", "start", "end", "added"), s, strict=True)) for s in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], ["id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(scan, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, added: boolean>>")
    return found.withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["added"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: ~s["added"] & (s["kind"] == k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["added"])).cast("bigint").alias("n_added"))
