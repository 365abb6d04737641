"""Verdicts on companies: batches that a model is asked about, and its captured answers as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

ANSWER = "results array<struct<i:string,match:string,industry:string,country:string,evidence:string>>"


def batches(companies: DataFrame, n: int) -> DataFrame:
    """Companies (domain, ...) with ``batch``, one of ``n`` by the domain's md5, and ``i``, the place in it from 0.

    ``n`` is the number of companies over the wanted size of a batch, so batches stay near that size at any scale.
    """
    batch = F.conv(F.substring(F.md5("domain"), 1, 8), 16, 10).cast("long") % n
    placed = companies.withColumn("batch", batch.cast("int"))
    return placed.withColumn("i", F.row_number().over(Window.partitionBy("batch").orderBy("domain")) - 1)


def entry(longest: int = 500) -> Column:
    """One company as the model sees it: its place, name, site and the beginning of its summary, on one line."""
    said = F.translate(F.substring(F.coalesce("summary", F.lit("")), 1, longest), "\n", " ")
    return F.format_string('[%d] name="%s" site=%s summary="%s"', "i", F.coalesce("company", F.lit("")), F.col("domain"), said)


def prompts(batched: DataFrame, task: str) -> DataFrame:
    """(batch, prompt): the task, then the batch's companies in order."""
    lines = F.array_sort(F.collect_list(F.struct("i", entry().alias("line"))))
    return batched.groupBy("batch").agg(F.concat_ws("\n", F.lit(task), F.transform(lines, lambda x: x["line"])).alias("prompt"))


def verdicts(answers: DataFrame) -> DataFrame:
    """(batch, i, match, industry, country, evidence) of answers (batch, raw), talk around their JSON ignored.

    A place that is named twice counts as named last; an entry without a whole number as its place is dropped.
    """
    named = answers.select("batch", F.posexplode(text.parse_object(F.col("raw"), ANSWER)["results"]).alias("at", "r"))
    kept = named.select("batch", F.col("r.i").try_cast("int").alias("i"), "at", F.lower(text.strip(F.coalesce("r.match", F.lit("unknown")))).alias("match"), *(F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in ("industry", "country", "evidence")))
    last = kept.filter("i is not null").groupBy("batch", "i").agg(F.max_by(F.struct("match", "industry", "country", "evidence"), "at").alias("v"))
    return last.select("batch", "i", "v.*")


def judged(batched: DataFrame, answers: DataFrame) -> DataFrame:
    """The companies with the verdict on them; ``unknown`` where the model gave none."""
    found = verdicts(answers).withColumnsRenamed({"match": "verdict", "industry": "verdict_industry", "country": "verdict_country", "evidence": "verdict_evidence"})
    joined = batched.join(found, ["batch", "i"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("unknown" if c == "verdict" else "")) for c in ("verdict", "verdict_industry", "verdict_country", "verdict_evidence")})
