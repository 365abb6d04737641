"""Text columns: white space, words, stems, sentences. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squish(c: Column) -> Column:
    """Runs of white space become one space, none at the ends; null becomes empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), "^ | $", "")


def strip(c: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row, however often lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def plain_words(c: Column) -> Column:
    """Runs of ASCII letters, digits and apostrophes, as written."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z0-9']+)"), 1)


def stem(c: Column) -> Column:
    """A common ending goes if four characters are left, then a final e of words of five and more."""
    short = F.regexp_replace(F.lower(c), "^(.{4,}?)(?:ings|ing|ers|er|ed|es|s)$", "$1")
    return F.when((F.length(short) >= 5) & short.endswith("e"), F.substr(short, F.lit(1), F.length(short) - 1)).otherwise(short)


def stems(c: Column) -> Column:
    return F.transform(words(c), stem)


def title(c: Column) -> Column:
    """Every run of letters starts with a capital and goes on in lower case."""
    chars = F.split(F.lower(c), "")
    return F.array_join(F.transform(chars, lambda x, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"^\p{L}$"), F.upper(x)).otherwise(x)), "")


def ordered_distinct(items: Column) -> Column:
    return F.array_distinct(items)


def join_present(*items: Column, by: str = " | ") -> Column:
    """The non-null items, joined: how reasons and warnings are written."""
    return F.concat_ws(by, *items)


def sentences(c: Column) -> Column:
    """Parts between sentence ends or line breaks, squished, stripped of dashes and bars; empty ones dropped."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+|\n+")
    clean = F.transform(parts, lambda s: F.regexp_replace(squish(s), r"^[\s\-–—|]+|[\s\-–—|]+$", ""))
    return F.filter(clean, lambda s: s != "")


def unrepeat(c: Column, passes: int = 3) -> Column:
    """A phrase of 18 to 80 characters that directly repeats itself is kept once; done ``passes`` times."""
    for _ in range(passes):
        c = F.regexp_replace(c, r"(?iu)(?<![\p{L}\p{N}_])(.{18,80}?)\s+\1(?![\p{L}\p{N}_])", "$1")
    return c


def clean_lines(c: Column, junk: str) -> Column:
    """Lines of 15 characters and more that neither start with ``junk`` nor carry a relative time, each once whatever its case."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0B\f]"), strip)
    kept = F.filter(lines, lambda s: (F.length(s) >= 15) & ~s.rlike(junk) & ~s.rlike(r"(?i)\d+\s*min ago|just now|yesterday|· \d+"))
    placed = F.array_sort(F.transform(kept, lambda s, i: F.struct(F.lower(s).alias("low"), i.alias("i"), s.alias("s"))))
    firsts = let(placed, lambda a: F.filter(a, lambda x, i: (i == 0) | (x["low"] != F.get(a, i - 1)["low"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"], x["s"]))), lambda x: x["s"])


def usable(c: Column) -> Column:
    """At least 30 characters, two fifths of them letters, digits or white space, and no sign of broken encoding at the start."""
    start = F.substring(c, 1, 500)
    readable = F.length(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}\s]", "")) / F.greatest(F.length(c), F.lit(1))
    broken = start.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]|\\\\x[0-9a-f]{2}|\\\\u[0-9a-f]{4}|[�￾￿]|[^\\x00-\\x7F]{10,}")
    return F.coalesce((F.length(strip(c)) >= 30) & (readable >= 0.4) & ~broken, F.lit(False))


def shorten(c: Column, n: int = 22) -> Column:
    """The first ``n`` words, with an ellipsis if there are more."""
    parts = F.split(strip(c), r"(?U)\s+")
    return F.when(F.size(parts) <= n, F.array_join(parts, " ")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit("…")))


def parse_object(raw: Column, schema: str) -> Column:
    """The JSON object inside a model's answer, fences and talk around it ignored; null if there is none."""
    bare = F.regexp_replace(raw, "```(?:json)?", "")
    return F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")), schema)
