"""Two-column pages from positioned runs of text: the border between the columns, visual lines, rows.

Runs are rows (doc, page, x, y, width, text) with y counted from the bottom.
Nothing looks at more than a page at a time but the border, which sums a
document's ink over a strip of fixed width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.trees import TEXT, marked

#: Where the border is looked for, as shares of a page's width, and how far a run may reach over it.
STRIP = (0.45, 0.55)
TOLERANCE = 3.0
#: Runs whose baselines differ by no more are on one line.
BASELINE = 2.0


def column_border(runs: DataFrame, key: list[str], width: float) -> DataFrame:
    """The emptiest position of the middle strip over all pages of each ``key``: key, border, ink (runs that cross it).

    Ink is counted at whole positions by what begins and ends there; of equally
    empty ones, that nearest the middle wins, then the left one. A document
    without ink in the strip is cut in the middle.
    """
    low, high = int(width * STRIP[0]), -int(-width * STRIP[1] // 1)
    text = runs.where(F.trim("text") != "")
    a, b = F.greatest(F.lit(low), F.floor("x").cast("int")), F.least(F.lit(high), F.ceil(F.col("x") + F.col("width")).cast("int"))
    turn = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    # Every run tells where the strip begins, so documents without ink have a row; ink is the same from one turn to the next.
    turns = F.when(a <= b, F.array(turn(F.lit(low), 0), turn(a, 1), turn(b + 1, -1))).otherwise(F.array(turn(F.lit(low), 0)))
    counted = text.select(*key, F.explode(turns).alias("e")).where(f"e.at <= {high}").groupBy(*key, "e.at").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*key).orderBy("at")
    until = F.coalesce(F.lead("at").over(w) - 1, F.lit(high))
    inked = counted.select(*key, "at", until.alias("to"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ink"))
    near = lambda middle: F.least(F.greatest(F.lit(int(middle)), "at"), "to")
    of = lambda at: F.struct("ink", F.abs(at - width / 2).alias("off"), at.alias("at"))
    best = inked.groupBy(*key).agg(F.min(F.least(of(near(width / 2 // 1)), of(near(-(-width / 2 // 1))))).alias("m"))
    return best.select(*key, F.col("m.at").alias("border"), F.col("m.ink").alias("ink"))


def visual_lines(runs: DataFrame, key: list[str], page: list[str]) -> DataFrame:
    """Runs with ``line``, their line on the page from the top: a line begins where the baseline falls by more than ``BASELINE``."""
    w = Window.partitionBy(*key, *page).orderBy(F.desc("y"), "x")
    falls = F.coalesce((F.lag("y").over(w) - F.col("y") > BASELINE).cast("int"), F.lit(0))
    return runs.withColumn("_falls", falls).withColumn("line", F.sum("_falls").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_falls")


def _joined(side: str) -> Column:
    """The texts of a side's runs from left to right."""
    told = F.transform(F.filter("_runs", lambda r: r["side"] == side), lambda r: r["text"])
    return F.trim(F.regexp_replace(F.array_join(told, " "), r"\s+", " "))


def two_columns(runs: DataFrame, key: list[str], page: list[str], width: float) -> DataFrame:
    """Lines of two columns: key, page, line, left, right, spanning.

    A run belongs to the side its middle is on; one that begins left of the
    border and reaches over it spans both.
    """
    # Dealt by the key once: its pages, its border and its lines are met there.
    lines = visual_lines(runs.where(F.trim("text") != "").repartition(*key), key, page).join(column_border(runs, key, width), key)
    end = F.col("x") + F.col("width")
    side = F.when((F.col("x") < F.col("border")) & (end > F.col("border") + TOLERANCE), "spanning").when(F.col("x") + F.col("width") / 2 < F.col("border"), "left").otherwise("right")
    listed = lines.withColumn("side", side).groupBy(*key, *page, "line").agg(F.sort_array(F.collect_list(F.struct("x", "text", "side"))).alias("_runs"))
    return listed.select(*key, *page, "line", *[_joined(s).alias(s) for s in ("left", "right", "spanning")])


def table_rows(lines: DataFrame, key: list[str], page: list[str]) -> DataFrame:
    """Rows of the table that lines of two columns print: key, row, heading, left, right, lines.

    A row begins at a line that spans both columns (its heading) and at one whose
    left or right side begins with a designation; it goes on over pages. Row 0
    is what stands before the first.
    """
    opens = (F.col("spanning") != "") | (marked(F.col("left"))["level"] < TEXT) | (marked(F.col("right"))["level"] < TEXT)
    w = Window.partitionBy(*key).orderBy(*page, "line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("row", F.sum(opens.cast("int")).over(w))
    order = F.struct(*page, "line")
    column = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(c) != "", F.struct(order.alias("o"), F.col(c).alias("t"))))), lambda x: x["t"]), " ")
    return numbered.groupBy(*key, "row").agg(column("spanning").alias("heading"), column("left").alias("left"), column("right").alias("right"), F.count(F.lit(1)).alias("lines"))
