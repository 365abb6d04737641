"""Lead tables and source lists in files, and the tables that are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.contacts import display_name
from tessera.functions.text import strip


def read_leads(spark: SparkSession, path: str, require_email: bool = True) -> DataFrame:
    """A CSV with a header, all columns as text; banner and blank rows dropped, the name filled from its parts.

    Raises ValueError if a column that leads need is missing.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    df = df.toDF(*(c.strip().lower() for c in df.columns))
    missing = {"company", *(["email"] if require_email else [])} - set(df.columns)
    if missing or not {"name", "first_name"} & set(df.columns):
        raise ValueError(f"columns missing: {', '.join(sorted(missing)) or 'name'}")
    filled = df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns))
    blank = F.forall(F.array(*(strip(F.col(c)) for c in df.columns)), lambda v: v == "")
    kept = filled.filter(~blank & ~F.col("company").rlike("^\\s*═"))
    part = lambda c: F.col(c) if c in df.columns else F.lit("")
    return kept.withColumn("name", display_name(part("name"), part("first_name"), part("last_name")))


def require_websites(leads: DataFrame, on_missing: str = "drop") -> DataFrame:
    """Rows without a website are dropped or kept, as told."""
    if "website" not in leads.columns or on_missing == "keep":
        return leads
    return leads.filter(strip(F.col("website")) != "")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """One source a line; blank lines and comments dropped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("source"))
    return lines.filter((F.col("source") != "") & ~F.col("source").startswith("#"))


def company_table(rows: DataFrame, with_people: bool = False) -> DataFrame:
    """The columns of the company table in their order, as text, missing ones empty; the place keeps verified rows first."""
    wanted = fixed.COMPANY_COLUMNS + (fixed.PEOPLE_COLUMNS if with_people else [])
    columns = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in wanted]
    ordered = rows.orderBy("place") if "place" in rows.columns else rows
    return ordered.select(*columns)


def write_table(df: DataFrame, path: str, form: str = "csv") -> None:
    """CSV with a header and doubled quotes, or JSON lines; as many files as the plan has partitions."""
    if form == "csv":
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    elif form == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown form {form}")


def sendable(drafts: DataFrame) -> DataFrame:
    """Drafts with an address and a text that is no error."""
    text = F.coalesce("generated_email", F.lit(""))
    return drafts.filter((F.coalesce("email", F.lit("")) != "") & (text != "") & ~text.startswith("ERROR:"))


def lead_report(leads: DataFrame, allow_missing_email: bool = False, on_missing: str = "drop") -> DataFrame:
    """One row about a lead table before a run: rows without an address or website, how many go on, and what stands in the way (empty: nothing)."""
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == "" if c in leads.columns else F.lit(True)
    has_website = "website" in leads.columns
    goes_on = ~blank("website") if has_website and on_missing == "drop" else F.lit(True)
    counts = leads.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(blank("email")).alias("no_email"), F.count_if(blank("website")).alias("no_website"), F.count_if(goes_on).alias("n_kept"))
    stop = F.when(F.lit(not allow_missing_email) & (F.col("no_email") > 0), "missing_email").when(F.col("n_kept") == 0, "no_rows_left").otherwise("")
    return counts.withColumns({"has_website": F.lit(has_website), "problem": stop, "n_kept": F.when(stop == "", F.col("n_kept")).otherwise(0)})


def contactable(rows: DataFrame) -> DataFrame:
    """Companies with an address."""
    return rows.filter(F.coalesce("email", F.lit("")) != "")


def issues(rows: DataFrame) -> DataFrame:
    """(label, email, score, warnings) of rows that need a look: their warnings, and that their text could not be written."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    given = lambda c: F.nullif(c, F.lit(""))
    failed = F.when(text("generated_email").startswith("ERROR:"), "generation_failed")
    warned = F.concat_ws(" | ", given(text("quality_warnings")), failed)
    label = F.coalesce(given(display_name(text("name"), text("first_name"), text("last_name"))), text("email"))
    return rows.select(label.alias("label"), text("email").alias("email"), F.coalesce(given(text("personalization_score")), F.lit("n/a")).alias("score"), warned.alias("warnings")).filter("warnings <> ''")
