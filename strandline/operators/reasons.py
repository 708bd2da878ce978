"""Passages of explanations joined to the units that they explain: by ranges of numbers, then by the longest address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a heading names items, a range of items and a paragraph.
_ITEMS = r"(?i)\bZ(?:iffer)?\s*(\d+)(?:\s*(?:bis|–|-)\s*(\d+))?"
_PARAGRAPH = r"§\s*(\d+[a-z]?)((?:\s*(?:Abs\.?|Z|lit\.?)\s*\w+)*)"


def named_range(heading: Column) -> Column:
    """Struct (first, last) of the item numbers that a heading names; null without one. A range that runs backwards is its first number."""
    first, last = (F.regexp_extract(heading, _ITEMS, i).try_cast("int") for i in (1, 2))
    return F.when(first.isNotNull(), F.struct(first.alias("first"), F.when(last >= first, last).otherwise(first).alias("last")))


def named_address(heading: Column) -> Column:
    """The address that a heading names, from the paragraph down, as parts joined by blanks: ``§3 abs2 lita``; null without a paragraph."""
    paragraph = F.regexp_extract(heading, _PARAGRAPH, 1)
    below = F.transform(F.regexp_extract_all(F.regexp_extract(heading, _PARAGRAPH, 2), F.lit(r"(?i)(?:Abs\.?|Z|lit\.?)\s*\w+"), F.lit(0)), lambda p: F.lower(F.regexp_replace(p, r"[\s.]", "")))
    return F.when(paragraph != "", F.array_join(F.concat(F.array(F.concat(F.lit("§"), paragraph)), below), " "))


def prefixes(address: Column) -> Column:
    """All addresses that an address lies in, itself last."""
    parts = F.split(address, " ")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), " "))


def within(points: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """The range that each point lies in: key, number, pos. Of several, the one begun last if it reaches the point, else the one that reaches furthest.

    Ranges (key, pos, first, last) and points (key, number) stand on one axis; a
    point looks back over running maxima, so a range is never spread over its numbers.
    """
    none = F.lit(None)
    begin = ranges.select(*key, F.col("first").alias("number"), F.lit(0).alias("_side"), F.struct("first", "last", F.col("pos").alias("pos")).alias("_begun"), F.struct("last", "first", F.col("pos").alias("pos")).alias("_far"))
    point = points.select(*key, "number").distinct().select(*key, "number", F.lit(1).alias("_side"), none.cast(begin.schema["_begun"].dataType).alias("_begun"), none.cast(begin.schema["_far"].dataType).alias("_far"))
    w = Window.partitionBy(*key).orderBy("number", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = begin.unionByName(point).select(*key, "number", "_side", F.max("_begun").over(w).alias("b"), F.max("_far").over(w).alias("f")).where("_side = 1")
    pos = F.when(F.col("b.last") >= F.col("number"), F.col("b.pos")).when(F.col("f.last") >= F.col("number"), F.col("f.pos"))
    return found.select(*key, "number", pos.alias("pos")).where("pos IS NOT NULL")


def explained(units: DataFrame, passages: DataFrame, key: list[str]) -> DataFrame:
    """Every unit with the passage that explains it: key, unit, passage, via (number or address), gap.

    Units (key, unit, number, address), passages (key, pos, heading). The number
    joins first, unless the passage names a paragraph that is not the unit's; then
    the longest address that a passage names and the unit lies in, the first such
    passage. ``gap``: ``no passages``, ``clash`` (the number's passage is
    about another paragraph) or ``not named``.
    """
    read = passages.select(*key, "pos", named_range(F.col("heading")).alias("r"), named_address(F.col("heading")).alias("a"))
    paragraph = lambda a: F.element_at(F.split(a, " "), 1)
    numbered = within(units.where("number IS NOT NULL"), read.where("r IS NOT NULL").select(*key, "pos", "r.first", "r.last"), key)
    numbered = numbered.join(read.select(*key, "pos", F.col("a").alias("_said")), [*key, "pos"]).withColumnRenamed("pos", "_by_number")
    named = read.where("a IS NOT NULL").groupBy(*key, "a").agg(F.min("pos").alias("_pos"))
    asked = units.where("address IS NOT NULL").select(*key, "unit", F.posexplode(prefixes(F.col("address"))).alias("_depth", "a"))
    by_address = asked.join(named, [*key, "a"]).groupBy(*key, "unit").agg(F.max_by("_pos", "_depth").alias("_by_address"))
    there = passages.select(*key).distinct().withColumn("_any", F.lit(True))
    found = units.join(numbered, [*key, "number"], "left").join(by_address, [*key, "unit"], "left").join(there, key, "left")
    fits = F.col("_said").isNull() | F.col("address").isNull() | (paragraph(F.col("_said")) == paragraph(F.col("address")))
    by_number = F.when(fits, F.col("_by_number"))
    via = F.when(by_number.isNotNull(), "number").when(F.col("_by_address").isNotNull(), "address")
    gap = F.when(via.isNotNull(), None).when(F.col("_any").isNull(), "no passages").when(F.col("_by_number").isNotNull(), "clash").otherwise("not named")
    return found.select(*key, "unit", F.coalesce(by_number, "_by_address").alias("passage"), via.alias("via"), gap.alias("gap"))
