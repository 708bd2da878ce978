"""Versions of a unit in two times: valid on a day, and known on a day; holes bridged only where the record proves them.

A unit's history is as many versions as it has had, so it travels as one array;
questions join it by the unit alone, and every rule is a filter of that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histories(versions: DataFrame, unit: str) -> DataFrame:
    """One row per unit: unit, history (array of version, since, until, amended, repeal, recorded, replaced; until null while in force).

    ``replaced``: the day on which the next version for the same beginning was
    recorded, null if none was. Versions without a day of record are never known.
    """
    w = Window.partitionBy(unit, "since").orderBy("recorded", "version")
    rows = versions.where("recorded IS NOT NULL").withColumn("replaced", F.when(F.col("since").isNotNull(), F.lead("recorded").over(w)))
    return rows.groupBy(unit).agg(F.collect_list(F.struct("version", "since", "until", "amended", "repeal", "recorded", "replaced")).alias("history"))


def known_on(history: Column, known: Column) -> Column:
    """The versions recorded by a day; of several recorded for one beginning, the last (a correction replaces what it corrects)."""
    return F.filter(history, lambda v: (v["recorded"] <= known) & (v["replaced"].isNull() | (v["replaced"] > known)))


def _first(found: Column, by: str, ascending: bool) -> Column:
    """The version of the array with the least (greatest) ``by``, then the least (greatest) number; null of none."""
    keyed = F.transform(found, lambda v: F.struct(v[by].alias("by"), v["version"].alias("version"), v.alias("v")))
    # Versions hold no map, so structs of them are ordered.
    return (F.array_min(keyed) if ascending else F.array_max(keyed))["v"]


def as_of(questions: DataFrame, versions: DataFrame, unit: str) -> DataFrame:
    """Answer questions (id, unit, day, known) from ``versions`` (unit, version, since, until, amended, repeal, recorded): id, version, how.

    ``in_force``: a version covers the day; of several the one begun last.
    ``bridged``: none does, but one ended before and its successor came by an
    amendment of a later year than the day, and neither is a repeal: the earlier
    one stood. ``promulgated``: none began by the day, and the first came by an
    amendment of an earlier year. ``repealed``: the covering version is a repeal.
    ``gap`` or ``unknown`` (no version recorded by then): no version.
    """
    found = questions.join(histories(versions, unit), unit, "left")
    found = found.select("id", "day", known_on(F.coalesce("history", F.array().cast(histories(versions, unit).schema["history"].dataType)), F.col("known")).alias("h"))
    year = F.year("day")
    covering = _first(F.filter("h", lambda v: (v["since"] <= F.col("day")) & (v["until"].isNull() | (v["until"] >= F.col("day")))), "since", False)
    before = _first(F.filter("h", lambda v: v["until"] < F.col("day")), "until", False)
    after = _first(F.filter("h", lambda v: v["since"] > F.col("day")), "since", True)
    begun = F.exists("h", lambda v: v["since"] <= F.col("day"))
    found = found.select("id", year.alias("year"), covering.alias("c"), before.alias("b"), after.alias("a"), begun.alias("begun"), (F.size("h") == 0).alias("none"))
    bridged = F.col("b").isNotNull() & F.col("a").isNotNull() & ~F.col("b.repeal") & ~F.col("a.repeal") & (F.col("a.amended") > F.col("year"))
    promulgated = ~F.col("begun") & F.col("a").isNotNull() & ~F.col("a.repeal") & (F.col("a.amended") < F.col("year"))
    how = F.when(F.col("none"), "unknown").when(F.col("c.repeal"), "repealed").when(F.col("c").isNotNull(), "in_force").when(bridged, "bridged").when(promulgated, "promulgated").otherwise("gap")
    version = F.when(how == "in_force", F.col("c.version")).when(how == "bridged", F.col("b.version")).when(how == "promulgated", F.col("a.version"))
    return found.select("id", version.alias("version"), how.alias("how"))


def coalesced(versions: DataFrame, unit: str, text: str) -> DataFrame:
    """Versions of equal ``text`` that follow each other without a day between, as one: unit, text, since, until, versions.

    Islands: a version opens one if its text differs from the one before or begins more than a day after all earlier ones ended.
    """
    w = Window.partitionBy(unit).orderBy("since", "version")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    open_end = F.to_date(F.lit("9999-12-31"))
    ended = F.max(F.coalesce("until", open_end)).over(earlier)
    opens = ended.isNull() | ~F.lag(text).over(w).eqNullSafe(F.col(text)) | (F.datediff("since", ended) > 1)
    w_so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    opened = versions.select(unit, text, "since", "version", F.coalesce("until", open_end).alias("_until"), opens.cast("int").alias("_opens"), F.row_number().over(w).alias("_at"))
    runs = opened.withColumn("_run", F.sum("_opens").over(w_so_far))
    # Runs rise in the order of the window, so the greatest (run, value) so far is of the row's own run: its last row tells of it, without a table of runs.
    so_far = lambda c: F.max(F.struct("_run", c.alias("x"))).over(w_so_far)["x"]
    first = F.date_sub(open_end, so_far(F.datediff(open_end, F.col("since"))))
    begun = F.max(F.when(F.col("_opens") == 1, F.col("_at"))).over(w_so_far)
    told = runs.select(unit, text, first.alias("since"), so_far(F.col("_until")).alias("_last"), (F.col("_at") - begun + 1).cast("long").alias("versions"), F.coalesce(F.lead("_run").over(w) > F.col("_run"), F.lit(True)).alias("_ends"))
    return told.where("_ends").select(unit, text, "since", F.when(F.col("_last") < open_end, F.col("_last")).alias("until"), "versions")
