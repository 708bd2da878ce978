"""Amending instructions read into operations and applied to units, as joins and windows instead of a loop over a text.

Inside an epoch an instruction changes the unit that it addresses and no other,
so what stands at an address when an instruction comes follows from the
insertions and deletions there before it: a group by address. Renumberings that
follow each other are one step, done at once for all of them, and end an epoch;
so jobs grow with the renumbering steps of a law, not with its instructions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.shared import written

_PLACE = r"(?:§\s*(\d+[a-z]?))?\s*(?:Abs\.\s*(\d+[a-z]?))?"
_QUOTED = r"„([^“]*)“"
#: Fixed formats: how an instruction is worded, by kind. Groups 1 and 2 are the place.
FORMS = {
    "delete": rf"^{_PLACE}\s+(?:entfällt|wird aufgehoben)\.?$",
    "replace": rf"^{_PLACE}\s+lautet:\s*{_QUOTED}\.?$",
    "insert": rf"^Folgender\s+{_PLACE}\s+wird eingefügt:\s*{_QUOTED}\.?$",
    "renumber": rf"^{_PLACE}\s+erhält die Bezeichnung\s+„{_PLACE}“\.?$",
    "phrase": rf"^In\s+{_PLACE}\s+wird\s+{_QUOTED}\s+durch\s+{_QUOTED}\s+ersetzt\.?$",
}


def _address(paragraph: Column, subsection: Column) -> Column:
    return F.concat(F.lit("§"), paragraph, F.when(subsection != "", F.concat(F.lit("/"), subsection)).otherwise(""))


def parsed(lines: DataFrame, key: list[str], seq: str, line: str) -> DataFrame:
    """Instructions of ``lines``: key, seq, kind, address, target, old, new; kind null where no form fits.

    A place without a paragraph is one of the paragraph that the last line before named; without any, its address is null.
    """
    said = F.trim(F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\s+", " "))
    kind = F.coalesce(*[F.when(F.col("said").rlike(form), k) for k, form in FORMS.items()], F.lit(None))
    group = lambda i: F.coalesce(*[F.when(F.col("kind") == k, F.regexp_extract("said", form, i)) for k, form in FORMS.items() if form.count("(") - form.count("(?:") >= i], F.lit(""))
    # A step each, so that a line is folded once, not once for each form.
    rows = lines.select(*key, F.col(seq).alias("seq"), said.alias("said")).withColumn("kind", kind)
    rows = rows.select(*key, "seq", "kind", group(1).alias("p"), group(2).alias("s"), group(3).alias("a"), group(4).alias("b"))
    # The window of ``_epochs``: a key's lines are dealt and sorted once for both.
    named = F.last(F.when(F.col("p") != "", F.col("p")), ignorenulls=True).over(Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("named", named)
    paragraph = F.when(F.col("p") != "", F.col("p")).otherwise(F.col("named"))
    of = lambda p, s: F.when(p.isNotNull() & (p != ""), _address(p, s))
    target = F.when(F.col("kind") == "renumber", of(F.when(F.col("a") != "", F.col("a")).otherwise(paragraph), F.col("b")))
    old, new = F.when(F.col("kind") == "phrase", F.col("a")), F.when(F.col("kind").isin("replace", "insert"), F.col("a")).when(F.col("kind") == "phrase", F.col("b"))
    nowhere = (F.col("p") == "") & (F.col("s") == "")
    return rows.select(*key, "seq", "kind", F.when(F.col("kind").isNotNull() & ~nowhere, of(paragraph, F.col("s"))).alias("address"), target.alias("target"), old.alias("old"), new.alias("new"))


def _epochs(instructions: DataFrame, key: list[str]) -> DataFrame:
    """Instructions with ``epoch``: how many renumbering steps came before; a step is a run of renumberings."""
    w = Window.partitionBy(*key).orderBy("seq")
    renumbers = F.coalesce(F.col("kind") == "renumber", F.lit(False))
    ends = (~renumbers & F.coalesce(F.lag(renumbers).over(w), F.lit(False))).cast("int")
    return instructions.withColumn("_ends", ends).withColumn("epoch", F.sum("_ends").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_ends")


def _edited(units: DataFrame, steps: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Units after an epoch's edits, and the verdict on each: key, seq, refusal (null if done)."""
    place = [*key, "address"]
    first = units.select(*place, F.lit(-1).cast("long").alias("seq"), F.lit("unit").alias("kind"), F.lit(None).cast("string").alias("old"), F.col("text").alias("new"))
    every = first.unionByName(steps.where("address IS NOT NULL AND kind IS NOT NULL").select(*place, F.col("seq").cast("long"), "kind", "old", "new"))
    # What stands at an address, and its text, follow from its own few edits, walked in order.
    listed = every.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "old", "new"))).alias("_l"))
    begin = F.struct(F.lit(None).cast("string").alias("text"), F.lit(False).alias("stands"), F.array().cast("array<struct<seq:bigint,refusal:string>>").alias("out"))

    def walk(a: Column, e: Column) -> Column:
        missing = ~a["stands"] & e["kind"].isin("replace", "delete", "phrase")
        absent = (e["kind"] == "phrase") & a["stands"] & ~F.coalesce(F.contains(a["text"], e["old"]), F.lit(False))
        refusal = F.when((e["kind"] == "insert") & a["stands"], "already there").when(missing, "not there").when(absent, "no such words")
        text = F.when(refusal.isNotNull(), a["text"]).when(e["kind"] == "delete", F.lit(None)).when(e["kind"] == "phrase", F.replace(a["text"], e["old"], e["new"])).otherwise(e["new"])
        stands = F.when(e["kind"].isin("unit", "insert"), True).when(e["kind"] == "delete", False).otherwise(a["stands"])
        told = F.when(e["kind"] == "unit", a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(e["seq"].alias("seq"), refusal.alias("refusal")))))
        return F.struct(text.alias("text"), stands.alias("stands"), told.alias("out"))

    walked = written(listed.select(*place, F.aggregate("_l", begin, walk).alias("r")), "edited")
    units = walked.where("r.text IS NOT NULL").select(*place, "r.text")
    return units, walked.select(*key, F.explode("r.out").alias("o")).select(*key, "o.seq", "o.refusal")


def _renumbered(units: DataFrame, steps: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Units after one step of renumberings done at once, and the verdicts: all of a step or none.

    Every source stands, none is named twice, no two get one number, and a number
    that is taken is one that moves away itself: so cycles are as good as chains.
    """
    moves = steps.where("address IS NOT NULL AND target IS NOT NULL").select(*key, "seq", "address", "target")
    there = units.select(*key, "address").withColumn("_there", F.lit(True))
    again = moves.groupBy(*key, "address").agg((F.count(F.lit(1)) > 1).alias("_again"))
    twice = moves.groupBy(*key, "target").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    taken = there.join(moves.select(*key, "address"), [*key, "address"], "left_anti").select(*key, F.col("address").alias("target"), F.lit(True).alias("_taken"))
    judged = moves.join(there, [*key, "address"], "left").join(again, [*key, "address"]).join(twice, [*key, "target"]).join(taken, [*key, "target"], "left")
    bad = F.col("_there").isNull() | F.col("_again") | F.col("_twice") | F.coalesce("_taken", F.lit(False))
    refused = judged.where(bad).select(*key).distinct().withColumn("_refused", F.lit(True))
    verdicts = written(moves.join(refused, key, "left"), "moves")
    done = verdicts.where("_refused IS NULL").select(*key, "address", "target")
    moved = units.join(done, [*key, "address"], "left").select(*key, F.coalesce("target", "address").alias("address"), "text")
    return written(moved, "moved"), verdicts.select(*key, F.col("seq").cast("long"), F.when(F.col("_refused"), "numbers collide").alias("refusal"))


def applied(units: DataFrame, instructions: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Apply ``instructions`` (as ``parsed`` gives them) to ``units`` (key, address, text): the units after, and key, seq, refusal.

    Instructions come in the order of ``seq``; what cannot be done whole is
    refused and changes nothing. ``unread``: no form fits; ``no place``: no
    paragraph is named.
    """
    steps = written(_epochs(instructions, key), "instructions")
    told = steps.where("kind IS NULL OR address IS NULL OR (kind = 'renumber' AND target IS NULL)").select(*key, F.col("seq").cast("long"), F.when(F.col("kind").isNull(), "unread").otherwise("no place").alias("refusal"))
    # An epoch that ends with the lines may have no renumbering; then the units stay as edited.
    ends = {r["epoch"]: r["moves"] for r in steps.groupBy("epoch").agg(F.max(F.coalesce(F.col("kind") == "renumber", F.lit(False))).alias("moves")).collect()}
    for epoch in sorted(ends):
        now = steps.where(F.col("epoch") == epoch)
        units, edits = _edited(units, now.where("kind <> 'renumber'"), key)
        told = told.unionByName(edits)
        if ends[epoch]:
            units, moves = _renumbered(units, now.where("kind = 'renumber'"), key)
            told = told.unionByName(moves)
    return units, told
