"""Paragraph trees from flat lines: levels by marker, parents and paths by running maxima, rendering by ordered aggregates.

The parent of a line is the last earlier line of a lower level. As levels are
few, that is a running maximum per level; a line's path keeps, from the top
down, the last line of each level that no lower level has closed since. The
maxima run inside chunks of lines and are carried over from chunk to chunk, so a
document of any length is scanned by many tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a paragraph, a subsection, an item, a letter and a double letter are marked at the beginning of a line.
MARKERS = (r"§\s*(\d+[a-z]?)\.?", r"\((\d+[a-z]?)\)", r"(\d+[a-z]?)\.", r"([a-z])\)", r"([a-z]{2})\)")
#: The level of a line without a marker: it goes on with the text of the line that is open.
TEXT = len(MARKERS)
#: Lines that one task scans in a row.
CHUNK = 4096


def marked(line: Column) -> Column:
    """Struct (level, id, marker, body) of a line; level ``TEXT`` without a marker."""
    found = F.lit(None).cast("struct<level:int,id:string,marker:string,body:string>")
    for level, marker in reversed(list(enumerate(MARKERS))):
        whole = rf"^\s*({marker})(?:\s+(.*))?$"
        part = lambda i, whole=whole: F.regexp_extract(line, f"(?s){whole}", i)
        found = F.when(line.rlike(f"(?s){whole}"), F.struct(F.lit(level).alias("level"), part(2).alias("id"), part(1).alias("marker"), part(3).alias("body"))).otherwise(found)
    text = F.struct(F.lit(TEXT).alias("level"), F.lit("").alias("id"), F.lit("").alias("marker"), F.coalesce(line, F.lit("")).alias("body"))
    return F.coalesce(found, text)


def maxima_before(rows: DataFrame, key: list[str], pos: str, values: list[str], chunk: int = CHUNK) -> DataFrame:
    """``rows`` with, for each of ``values``, its maximum over the key's earlier rows (``_`` before the name; null without one).

    ``pos`` numbers a key's rows. A window holds at most ``chunk`` positions;
    what came before is carried as one row per chunk.
    """
    rows = rows.withColumn("_chunk", F.floor(F.col(pos) / chunk))
    sums = rows.groupBy(*key, "_chunk").agg(*[F.max(v).alias(f"_up_{v}") for v in values])
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*[F.col(k).alias(f"_key_{k}") for k in key], F.col("_chunk").alias("_of"), *[F.max(f"_up_{v}").over(earlier).alias(f"_up_{v}") for v in values])
    within = Window.partitionBy(*key, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in key], F.col("_chunk") == F.col("_of"))
    found = rows.select("*", *[F.max(v).over(within).alias(f"_in_{v}") for v in values]).join(carried, same)
    names = [c for c in rows.columns if c != "_chunk"]
    return found.select(*names, *[F.greatest(f"_in_{v}", f"_up_{v}").alias(f"_{v}") for v in values])


def tree(lines: DataFrame, key: list[str], pos: str, line: str, chunk: int = CHUNK) -> DataFrame:
    """The tree of each key's ``lines``: key, pos, level, id, marker, body, parent (pos; null at the top), path, depth.

    ``path`` is the array of (level, id, pos) from the top to the line itself.
    Lines without a marker are children of the line that is open; a null line
    is an empty one.
    """
    names = [f"l{level}" for level in range(TEXT)]
    rows = lines.select(*key, F.col(pos).alias("pos"), marked(F.col(line)).alias("m")).select(*key, "pos", "m.*")
    rows = rows.select("*", *[F.when(F.col("level") == level, F.struct("pos", "id")).alias(name) for level, name in enumerate(names)])
    found = maxima_before(rows, key, "pos", names, chunk)
    last = [F.col(f"_{name}") for name in names]
    open_until = lambda level: F.greatest(F.lit(-1), *[F.coalesce(a["pos"], F.lit(-1)) for a in last[:level]]) if level else F.lit(-1)
    held = [F.when((F.col("level") > level) & (a["pos"] > open_until(level)), F.struct(F.lit(level).alias("level"), a["id"].alias("id"), a["pos"].alias("pos"))) for level, a in enumerate(last)]
    above = F.array_compact(F.array(*held))
    found = found.withColumn("above", above)
    own = F.struct("level", "id", F.col("pos").alias("pos"))
    parent = F.when(F.size("above") > 0, F.element_at("above", -1)["pos"])
    return found.select(*key, "pos", "level", "id", "marker", "body", parent.alias("parent"), F.concat("above", F.array(own)).alias("path"), F.size("above").alias("depth"))


def address(path: Column) -> Column:
    """A path as ``§3/(2)/a)`` without its lines of text."""
    shown = F.array(*map(F.lit, ("§%s", "(%s)", "%s.", "%s)", "%s)")))
    named = F.filter(path, lambda p: p["level"] < TEXT)
    return F.array_join(F.transform(named, lambda p: F.replace(F.element_at(shown, p["level"] + 1), F.lit("%s"), p["id"])), "/")


def rendered(nodes: DataFrame, key: list[str], level: int | None = None) -> DataFrame:
    """The text of each tree, or of each node of ``level`` with all below it: key, (pos,) text, plain, lines.

    ``text`` is what the lines said, ``plain`` their bodies without markers. One
    row holds one text, as the source's did.
    """
    said = F.concat_ws(" ", F.nullif("marker", F.lit("")), F.nullif("body", F.lit("")))
    top: list[Column] = []
    if level is not None:
        nodes = nodes.withColumn("_top", F.try_element_at(F.filter("path", lambda p: p["level"] == level), F.lit(1))).where("_top IS NOT NULL")
        top = [F.col("_top.pos").alias("pos")]
    grouped = nodes.select(*key, *top, F.struct(F.col("pos").alias("at"), said.alias("said"), F.col("body").alias("body")).alias("line"))
    names = [*key, "pos"] if level is not None else key
    listed = grouped.groupBy(*names).agg(F.sort_array(F.collect_list("line")).alias("l"))
    bodies = F.filter(F.transform("l", lambda x: F.trim(x["body"])), lambda b: b != "")
    return listed.select(*names, F.array_join(F.transform("l", lambda x: x["said"]), "\n").alias("text"), F.array_join(bodies, " ").alias("plain"), F.size("l").alias("lines"))


def by_address(nodes: DataFrame, key: list[str]) -> DataFrame:
    """The marked nodes that their address names alone: key, address, pos. An address that two nodes carry names none."""
    named = nodes.where(F.col("level") < TEXT).select(*key, address(F.col("path")).alias("address"), "pos")
    return named.groupBy(*key, "address").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")).where("n = 1").drop("n")
