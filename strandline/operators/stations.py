"""A draft's way: the chain of stations over optional sides, coverage of a period, merged items, the gazette of an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: House statuses with which an item counts as decided.
DECIDED = ["5", "4", "3"]


def station(bill: Column, gazette: Column, status: Column, decided: Column) -> Column:
    """begutachtung without a bill; bgbl with a gazette number; parlament once decided; else rv, the weakest claim."""
    return F.when(bill.isNull(), "begutachtung").when(gazette.isNotNull(), "bgbl").when(decided.isNotNull() | status.isin(DECIDED), "parlament").otherwise("rv")


def chains(drafts: DataFrame, bills: DataFrame, house: DataFrame | None, gazettes: DataFrame | None, key: list[str], bill: str) -> DataFrame:
    """The chain of each draft: its last linked bill, the bill's house row and gazette entry, the station, and whether all sides were read.

    ``bills`` has the key, ``bill`` and linked_on; ``house`` has ``bill``, status and decided;
    ``gazettes`` has ``bill``, gazette and issued. A side that is None was not read: its
    columns are null and ``complete`` is false, which is no claim about the draft.
    """
    last = bills.groupBy(*key).agg(F.max(F.struct("linked_on", bill)).alias("l")).select(*key, F.col(f"l.{bill}").alias(bill), F.col("l.linked_on").alias("linked_on"))
    out = drafts.join(last, key, "left")
    complete = F.lit(house is not None and gazettes is not None)
    out = out.join(house.select(bill, "status", "decided"), bill, "left") if house is not None else out.withColumn("status", F.lit(None).cast("string")).withColumn("decided", F.lit(None).cast("date"))
    if gazettes is not None:
        # The earliest issue that names the bill: a later one is a correction.
        first = gazettes.groupBy(bill).agg(F.min(F.struct("issued", "gazette")).alias("g")).select(bill, F.col("g.gazette").alias("gazette"), F.col("g.issued").alias("issued"))
        out = out.join(first, bill, "left")
    else:
        out = out.withColumn("gazette", F.lit(None).cast("string")).withColumn("issued", F.lit(None).cast("date"))
    return out.withColumn("station", station(F.col(bill), F.col("gazette"), F.col("status"), F.col("decided"))).withColumn("complete", complete)


def coverage(periods: DataFrame, chained: DataFrame, period: str, ended: str) -> DataFrame:
    """linked, unlinked or unknown per period: only an ended period none of whose drafts went on is unlinked; no drafts are unknown."""
    went_on = chained.groupBy(period).agg(F.bool_or(F.col("station") != "begutachtung").alias("_on"))
    kind = F.when(F.col("_on").isNull(), "unknown").when(F.col("_on") | ~F.col(ended), "linked").otherwise("unlinked")
    return periods.join(went_on, period, "left").withColumn("coverage", kind).drop("_on")


def gazette_of(items: DataFrame, records: DataFrame, item: str, listed: str, on: list[str]) -> DataFrame:
    """Exact join of items with the records whose array ``listed`` names them, the earliest record first; items without one stay."""
    named = records.select(*on, "record", "issued", F.explode(listed).alias(item))
    first = named.groupBy(*on, item).agg(F.min(F.struct("issued", "record")).alias("r")).select(*on, item, F.col("r.record").alias("record"), F.col("r.issued").alias("issued"))
    return items.join(first, [*on, item], "left")


def merged_into(items: DataFrame, records: DataFrame) -> DataFrame:
    """Where an item was merged: the item it cites, or for a report the item that the report is on; two hops at most.

    ``items`` has item and cited; ``records`` has item, kind and main (a report's
    main item). What cannot be followed is null.
    """
    cited = records.select(F.col("item").alias("cited"), F.col("kind").alias("cited_kind"), F.col("main").alias("cited_main"))
    target = records.select(F.col("item").alias("cited_main"), F.col("kind").alias("main_kind"))
    joined = items.join(cited, "cited", "left").join(target, "cited_main", "left")
    report = F.col("cited_kind") == "report"
    return joined.select("item", F.when(report, F.col("cited")).alias("report"), F.when(report, F.col("cited_main")).when(F.col("cited_kind").isNotNull(), F.col("cited")).alias("merged"), F.when(report, F.col("main_kind")).otherwise(F.col("cited_kind")).alias("kind"))
