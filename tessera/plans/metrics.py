"""Figures of a run that come out of the run itself: counted while rows pass, without a job of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def filled(c: str) -> Column:
    return F.count_if(F.coalesce(F.col(c), F.lit("")) != "")


def written(c: str = "generated_email") -> Column:
    return F.count_if(~F.coalesce(F.col(c), F.lit("")).startswith("ERROR:"))


def figures(kind: str) -> dict[str, Column]:
    """The figures of drafts, companies, contacts or verified leads."""
    rows = F.count(F.lit(1))
    return {
        "drafts": lambda: {"n_rows": rows, "n_written": written()},
        "companies": lambda: {"n_rows": rows, "with_email": filled("email"), "with_phone": filled("phone"), "with_profile": filled("linkedin_company_url")},
        "contacts": lambda: {"n_rows": rows, "with_contact": filled("email"), "from_profiles": F.count_if(F.col("contact_type") == "linkedin_profile")},
        "verified": lambda: {"n_valid": F.count_if("valid"), "n_invalid": F.count_if(~F.col("valid"))},
    }[kind]()


class Run:
    """Collects the figures of the tables that a run writes; each is there once the table's action is over."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, **counted: Column) -> DataFrame:
        """The table as it is; what is ``counted`` of it is observed as its rows pass. A name can be watched once."""
        if name in self.seen:
            raise ValueError(f"{name} is watched already")
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], *(c.alias(k) for k, c in counted.items()))

    def of(self, name: str) -> dict:
        """The figures of a table that has been written; waits for its action."""
        return dict(self.seen[name].get)

    def result(self) -> dict[str, dict]:
        return {name: self.of(name) for name in self.seen}
