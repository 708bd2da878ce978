"""Two-column comparisons against the standing text: comparable words, elisions, coverage, verdicts; units of a text, courses of an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a column from which on it is evidence, and the share of them that the standing text must have.
PROSE = 5
COVERED = 0.95
#: Judged units from which on a share means anything, and the share below which a law is doubtful.
LEAST_JUDGED = 3
LAW_SHARE = 0.7
#: Characters that may stand in front of an elision as a heading.
HEADING = 80
#: What is no wording: notes, designations of units, marks of omission.
_NOTE = r"\(anm\.\s*:[^)]*\)|\[\s*kommentar\s*:[^\]]*\]"
_DESIGNATION = r"§+\s*\d+[a-z]*\.?|\(\d+[a-z]*\)|(?<![\p{L}\p{N}])\d+[a-z]?\.(?!\d)"
_MARK = r"\.\.\.|…"
#: One scan: what is no wording is consumed, what remains of three characters or more is a word.
_SCAN = f"{_NOTE}|{_DESIGNATION}|{_MARK}|([\\p{{L}}\\p{{N}}§\u00AD\u2011-]{{3,}})"
#: A cell that says nothing but what it leaves out.
_NOTATION = f"(?i)(?:{_DESIGNATION}|{_MARK}|\\b(?:bis|und)\\b|[\\s,.;–-])+"


def wording(text: Column) -> Column:
    """The words of a text that count when two texts are compared, in order."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(_SCAN), F.lit(1)), lambda w: w != "")
    return F.transform(found, lambda w: F.translate(w, "\u00AD\u2011", "--"))


def coverage(units: DataFrame, key: list[str], column: str, standing: str) -> DataFrame:
    """Per unit, how many of a column's words a standing text lacks: key, comparable, missing, ratio, prose.

    Words are counted per unit and word on both sides at once, so a unit's length costs no more than its words.
    """
    of = lambda c, n: units.select(*key, F.explode_outer(wording(F.col(c))).alias("_word"), F.lit(n).alias("_own"))
    words = of(column, 1).unionByName(of(standing, 0)).groupBy(*key, "_word").agg(F.sum("_own").alias("n"), F.min("_own").alias("least"))
    own = F.when(F.col("_word").isNotNull(), F.col("n")).otherwise(0)
    counted = words.groupBy(*key).agg(F.sum(own).cast("int").alias("comparable"), F.sum(F.when(F.col("least") == 1, own).otherwise(0)).cast("int").alias("missing"))
    ratio = F.when(F.col("comparable") == 0, 1.0).otherwise(1 - F.col("missing") / F.col("comparable"))
    return counted.withColumn("ratio", ratio).withColumn("prose", F.col("comparable") >= PROSE)


def law_verdicts(units: DataFrame, law: str) -> DataFrame:
    """verified, doubtful or unchecked per law, from its units' ratio and prose: unjudged units count neither way."""
    judged, passed = F.count_if("prose"), F.count_if(F.col("prose") & (F.col("ratio") >= COVERED))
    counted = units.groupBy(law).agg(judged.alias("judged"), passed.alias("verified"))
    doubtful = (F.col("judged") >= LEAST_JUDGED) & (F.col("verified") / F.col("judged") < LAW_SHARE)
    return counted.withColumn("verdict", F.when(F.col("judged") == 0, "unchecked").when(doubtful, "doubtful").otherwise("verified"))


def elision(current: Column, proposed: Column) -> Column:
    """elided (both columns only say that text is left out), range (only how far it is differs) or null.

    Cells are notation throughout, with the same digits; or alike, with no more than a heading beside the notation.
    """
    marked = current.rlike(_MARK) & proposed.rlike(_MARK)
    bare = current.rlike(f"^{_NOTATION}$") & proposed.rlike(f"^{_NOTATION}$")
    digits = lambda t: F.regexp_extract_all(t, F.lit(r"\d"), F.lit(0))
    heading = F.trim(F.regexp_replace(current, _NOTATION, " "))
    alike = (current == proposed) & (F.length(heading) <= HEADING)
    return F.when(marked, F.when(bare, F.when(digits(current) == digits(proposed), "elided").otherwise("range")).when(alike, "elided"))


def segmented(blocks: DataFrame, key: list[str], pos: str, text: str, opens: Column) -> DataFrame:
    """Blocks with the number of their unit (0 before the first): a block that ``opens`` begins one, unless it stands inside a quotation."""
    w = Window.partitionBy(*key).orderBy(pos)
    marks = F.length(text) - F.length(F.regexp_replace(F.regexp_replace(text, "[„“”]", '"'), '"', ""))
    quoted = F.coalesce(F.sum(marks).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    begun = blocks.withColumn("_open", (F.coalesce(opens, F.lit(False)) & ~quoted).cast("int"))
    return begun.withColumn("unit", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")


def first_stage(stages: DataFrame, key: list[str], pos: str, day: str, wanted: dict[str, Column]) -> DataFrame:
    """Per key, the day of the first stage that meets each condition of ``wanted`` (name -> condition); null without one."""
    return stages.groupBy(*key).agg(*[F.min_by(F.col(day), F.when(condition, F.col(pos))).alias(name) for name, condition in wanted.items()])


def courses(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Per key the course of its states without immediate repeats, its length, its last state and how often it came back to one."""
    w = Window.partitionBy(key).orderBy(*order)
    turns = events.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag(state).over(w))
    turns = turns.where(F.col("_before").isNull() | (F.col("_before") != F.col(state)))
    counted = turns.groupBy(key).agg(F.count(F.lit(1)).alias("steps"), F.count_distinct(state).alias("states"), F.max_by(state, "_n").alias("last_state"))
    return counted.select(key, "steps", (F.col("steps") - F.col("states")).alias("returns"), "last_state")


def best_ranked(items: DataFrame, key: list[str], rank: Column) -> DataFrame:
    """All items of the best rank of each key; rank 0 is no candidate."""
    ranked = items.withColumn("rank", rank).where("rank > 0")
    best = ranked.groupBy(*key).agg(F.max("rank").alias("rank"))
    return ranked.join(best, [*key, "rank"], "left_semi")
