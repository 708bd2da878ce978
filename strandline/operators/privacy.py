"""Privacy by construction: submitters are classed before anything is kept, persons are counted and never named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that show an organisation; a parameter, not a complete list.
ORGANISATION = r"(?i)\b(gmbh|ag|verein|verband|kammer|amt|ministerium|university|universität|institute|association|council|federation|ltd|inc|company|brand)\b"


def submitter_class(name: Column, public: Column, organisation: str = ORGANISATION) -> Column:
    """organisation, person or nonpublic. The flag may veto publication (false) but never authorise it; unknown names are persons."""
    clean = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), "[\\u00AD\\u200B-\\u200D\\uFEFF]", ""))
    return F.when(F.coalesce(public, F.lit(True)) == F.lit(False), "nonpublic").when(clean.rlike(organisation), "organisation").otherwise("person")


def without_persons(df: DataFrame, name: str, public: str, keep: list[str], organisation: str = ORGANISATION) -> DataFrame:
    """Allow-listed columns, the class, and the name of organisations alone."""
    kind = submitter_class(F.col(name), F.col(public), organisation)
    return df.select(*keep, kind.alias("submitter_class"), F.when(kind == "organisation", F.col(name)).alias("organisation"))
