"""Which law of a package a row of a comparison belongs to, and what its right column may say.

Candidate headings are joined to the articles of a draft by number and by title,
vetoed by printed order, and the rows between them take the law of the last
heading that stands. A package's headings and articles meet once, in one join by
package, and are judged by windows over it, so titles are shuffled once; a
package is read by one task, packages are spread.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.annex import wording
from strandline.sources.shared import written

#: A title is evidence from this likeness on; below the second, it contradicts the number.
TITLE_MATCH = 0.6
TITLE_AGREES = 0.34
#: Words of a stretch that is already in force; new and missing words, and share found, that make a row doubtful.
STANDING_STRETCH = 6
NEW_WORDS = 10
MISSING_WORDS = 8
FOUND_SHARE = 0.9
#: A numeral of Roman digits.
ROMAN = "^[IVXL]+$"


def met(candidates: DataFrame, articles: DataFrame, key: list[str]) -> DataFrame:
    """Every candidate with every article of its package: key, pos, heading (a digest), numeral, untitled, index, own (the article's numeral), named, amends, likeness (shared distinct words by all; null without a shared one)."""
    a = candidates.select(*key, "pos", F.md5(F.to_json(F.struct("numeral", "words"))).alias("heading"), "numeral", F.col("words").alias("_a"))
    b = articles.select(*key, "index", F.col("numeral").alias("own"), F.col("words").alias("_b"), "amends")
    shared = a.join(b, key).withColumn("_c", F.size(F.array_intersect("_a", "_b")))
    likeness = F.when(F.col("_c") > 0, F.col("_c") / (F.size("_a") + F.size("_b") - F.col("_c")))
    return shared.select(*key, "pos", "heading", "numeral", (F.size("_a") == 0).alias("untitled"), "index", "own", (F.size("_b") > 0).alias("named"), "amends", likeness.alias("likeness"))


def accepted(candidates: DataFrame, articles: DataFrame, key: list[str]) -> DataFrame:
    """Candidates that open a law: key, pos, index.

    Candidates (key, pos, numeral, words) in printed order; articles (key, index,
    numeral, words, amends) in the draft's. The number joins, Roman ones only
    where the draft numbers so and a number only where one article has it; a
    title that contradicts its article and fits another one alone overrides it;
    without a number, only the title of an amending article counts. A law opens
    once, at its first heading; what has the number alone for evidence may not
    jump back behind a law that was opened before.
    """
    at = Window.partitionBy(*key, "pos")
    pairs = met(candidates, articles, key).withColumn("_amending", F.when(F.col("amends"), F.col("likeness")))
    pairs = pairs.select("*", *[F.max(c).over(at).alias(f"_best_{c}") for c in ("likeness", "_amending")])
    # The one article whose title fits best at a position; none where another fits as well. Headings may share a position.
    fits = lambda c: (F.col(c) >= TITLE_MATCH) & (F.col(c) == F.col(f"_best_{c}"))
    clear = lambda c: F.when(F.count_if(fits(c)).over(at) == 1, F.min(F.when(fits(c), F.col("index"))).over(at))
    pairs = pairs.withColumns({"titled": clear("likeness"), "titled_amending": clear("_amending")})
    same = F.col("own") == F.col("numeral")
    only = lambda v: F.when(F.count_if(same) == 1, F.max(F.when(same, v)))
    c = pairs.groupBy(*key, "pos", "heading", "numeral", "untitled", "titled", "titled_amending").agg(
        only(F.col("index")).alias("numbered"), only(F.col("named")).alias("_named"), only(F.col("likeness")).alias("_fits"),
        F.bool_or(F.coalesce(F.col("own").rlike(ROMAN), F.lit(False))).alias("_roman"),
    )
    foreign = F.col("numeral").rlike(ROMAN) & ~F.col("_roman")
    untitled = F.col("untitled")
    agrees = untitled | ~F.col("_named") | (F.coalesce("_fits", F.lit(0.0)) >= TITLE_AGREES)
    overrides = ~agrees & (F.col("titled") != F.col("numbered"))
    by_number = F.when(F.coalesce(overrides, F.lit(False)), F.col("titled")).otherwise(F.col("numbered"))
    index = F.when(F.col("numeral").isNull(), F.col("titled_amending")).when(foreign, None).when(F.col("numbered").isNull(), F.col("titled")).otherwise(by_number)
    bare = F.col("numeral").isNotNull() & F.col("numbered").isNotNull() & ~F.coalesce(overrides, F.lit(False)) & (~agrees | untitled | F.col("titled").isNull())
    chosen = c.select(*key, "pos", index.alias("index"), bare.alias("bare")).where("index IS NOT NULL")
    first = chosen.groupBy(*key, "index").agg(F.min("pos").alias("pos"), F.min_by("bare", "pos").alias("bare"))
    ordered = first.withColumn("_index", F.max("index").over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    return ordered.where(~F.col("bare") | F.col("_index").isNull() | (F.col("index") > F.col("_index"))).select(*key, "pos", "index")


def resolved(candidates: DataFrame, articles: DataFrame, key: list[str], found: DataFrame | None = None) -> DataFrame:
    """One row per package: key, verdict, laws (headings that stand), whole (the one law of an undivided package).

    ``divided``: headings stand, and after each the draft's next amending
    article has one too. ``skipped``: an amending article after a heading has
    none, so no row can be given to a law. ``undrafted``: numbered candidates
    where the draft has no numbers. ``whole``: one law for all rows.
    ``undivided``: several laws and no heading. ``found`` is what ``accepted``
    gave, where it is known.
    """
    found = written(accepted(candidates, articles, key), "headings") if found is None else found
    amending = articles.where("amends").select(*key, "index")
    marks = amending.withColumn("_amends", F.lit(1)).unionByName(found.select(*key, "index").withColumn("_amends", F.lit(0))).repartition(*key).groupBy(*key, "index").agg(F.max("_amends").alias("_amends"), F.min("_amends").alias("_open"))
    # The next amending article behind each heading that stands: it has to have one itself.
    behind = Window.partitionBy(*key).orderBy("index").rowsBetween(1, Window.unboundedFollowing)
    following = F.min(F.when(F.col("_amends") == 1, F.struct("index", "_open"))).over(behind)
    skipped = marks.withColumn("_next", following).where("_open = 0 AND _next._open = 1").select(*key).distinct().withColumn("_skipped", F.lit(True))
    laws = found.groupBy(*key).agg(F.count(F.lit(1)).alias("laws"))
    drafted = articles.groupBy(*key).agg(F.count(F.lit(1)).alias("_articles"), F.count("numeral").alias("_numbers"), F.count_if("amends").alias("_amending"), F.min("index").alias("_first"), F.min(F.when(F.col("amends"), F.col("index"))).alias("_law"))
    numbered = candidates.where(F.col("numeral").isNotNull() & ~F.col("numeral").rlike(ROMAN)).select(*key).distinct().withColumn("_asked", F.lit(True))
    rows = drafted.join(laws, key, "left").join(skipped, key, "left").join(numbered, key, "left")
    one = F.when(F.col("_amending") == 1, F.col("_law")).when((F.col("_amending") == 0) & (F.col("_articles") == 1), F.col("_first"))
    none = F.when(F.col("_asked").isNotNull() & (F.col("_numbers") == 0), "undrafted").when(one.isNotNull(), "whole").when(F.col("_amending") > 1, "undivided").otherwise("whole")
    verdict = F.when(F.col("laws").isNull(), none).when(F.col("_skipped").isNotNull(), "skipped").otherwise("divided")
    return rows.select(*key, verdict.alias("verdict"), F.when(verdict == "divided", F.col("laws")).otherwise(0).cast("long").alias("laws"), F.when(verdict == "whole", one).alias("whole"))


def assigned(rows: DataFrame, candidates: DataFrame, articles: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` (key, pos) with ``law``: the article whose heading stands at or last before them, or the package's one law; null where none is sure."""
    # What is asked of a package once its headings are known, in one table: so its lines and titles are read, joined and shuffled once.
    # Nothing is asked of a package without a key; said of all inputs alike, so that what they share is one plan.
    rows, candidates, articles = (functools.reduce(lambda df, c: df.where(F.col(c).isNotNull()), key, df) for df in (rows.where("pos IS NOT NULL"), candidates, articles))
    rest = F.struct(*[c for c in rows.columns if c not in key], F.lit(True).alias("_is"))
    every = {"heading": (accepted(candidates, articles, key), ["pos", "index"]), "article": (articles, ["index", "numeral", "amends"]), "candidate": (candidates, ["numeral"]), "row": (rows.withColumn("_row", rest), ["pos", "_row"])}
    parts = [df.select(*key, F.lit(kind).alias("_kind"), *names) for kind, (df, names) in every.items()]
    table = written(functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts), "packages")
    found, drafted, printed, placed = (table.where(F.col("_kind") == kind).select(*key, *names) for kind, (_, names) in every.items())
    verdicts = resolved(printed, drafted, key, found)
    opened = found.select(*key, "pos", F.struct("pos", F.col("index").alias("law")).alias("_at"))
    # Headings may stand where no row does, and where several do.
    at = Window.partitionBy(*key).orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    carried = placed.unionByName(opened, allowMissingColumns=True).withColumn("_at", F.max("_at").over(at)).where("_row IS NOT NULL").join(verdicts, key, "left")
    law = F.when(F.col("verdict") == "divided", F.col("_at.law")).when(F.col("verdict") == "whole", F.col("whole"))
    return carried.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns], law.alias("law"))


def stretches(rows: DataFrame, key: list[str], current: str, proposed: str) -> DataFrame:
    """Runs of words that the proposed column has and the current one lacks, in order: key, pos, run, words, text."""
    had = rows.select(*key, "pos", F.explode(wording(F.col(current))).alias("_w")).distinct().withColumn("_had", F.lit(True))
    words = rows.select(*key, "pos", F.posexplode(wording(F.col(proposed))).alias("_i", "_w"))
    new = words.join(had, [*key, "pos", "_w"], "left").where("_had IS NULL")
    run = F.col("_i") - F.row_number().over(Window.partitionBy(*key, "pos").orderBy("_i"))
    found = new.withColumn("run", run).groupBy(*key, "pos", "run").agg(F.count(F.lit(1)).alias("words"), F.sort_array(F.collect_list(F.struct("_i", "_w"))).alias("_l"))
    return found.select(*key, "pos", "run", "words", F.array_join(F.transform("_l", lambda x: x["_w"]), " ").alias("text"))


def right_column(rows: DataFrame, standing: DataFrame, draft: DataFrame, key: list[str], current: str = "current", proposed: str = "proposed") -> DataFrame:
    """What speaks against a row's right column: key, pos, in_force, new_words, missing, doubtful, unproven.

    ``in_force``: a stretch that it inserts stands in the ``standing`` text (key,
    text) already. ``missing`` of its ``new_words`` stand nowhere in the
    ``draft`` (key, text); ``doubtful`` if they are many and few are found.
    ``unproven``: it is empty, a repeal, and the draft names no repeal.
    """
    runs = stretches(rows, key, current, proposed)
    said = lambda texts, name: texts.select(*key, F.concat(F.lit(" "), F.array_join(wording(F.col("text")), " "), F.lit(" ")).alias(name))
    long = runs.where(F.col("words") >= STANDING_STRETCH).join(said(standing, "_standing"), key)
    held = long.where(F.contains("_standing", F.concat(F.lit(" "), "text", F.lit(" ")))).select(*key, "pos").distinct().withColumn("in_force", F.lit(True))
    new = runs.select(*key, "pos", F.explode(F.split("text", " ")).alias("_w")).groupBy(*key, "pos", "_w").agg(F.count(F.lit(1)).alias("_n"))
    bag = draft.select(*key, F.explode(wording(F.col("text"))).alias("_w")).distinct().withColumn("_found", F.lit(True))
    counted = new.join(bag, [*key, "_w"], "left").groupBy(*key, "pos").agg(F.sum("_n").alias("new_words"), F.sum(F.when(F.col("_found").isNull(), F.col("_n")).otherwise(0)).alias("missing"))
    repeals = draft.select(*key, F.lower("text").rlike(r"entfällt|entfallen|aufgehoben|repealed").alias("_repeals"))
    repeal = (F.trim(F.coalesce(F.col(proposed), F.lit(""))) == "") & (F.size(wording(F.col(current))) > 0)
    found = rows.select(*key, "pos", F.coalesce(repeal, F.lit(False)).alias("_repeal")).join(held, [*key, "pos"], "left").join(counted, [*key, "pos"], "left").join(repeals, key, "left")
    n, m = F.coalesce("new_words", F.lit(0)).cast("long"), F.coalesce("missing", F.lit(0)).cast("long")
    doubtful = (n >= NEW_WORDS) & (m >= MISSING_WORDS) & (1 - m / F.greatest(n, F.lit(1)) < FOUND_SHARE)
    return found.select(*key, "pos", F.coalesce("in_force", F.lit(False)).alias("in_force"), n.alias("new_words"), m.alias("missing"), doubtful.alias("doubtful"), (F.col("_repeal") & ~F.coalesce("_repeals", F.lit(False))).alias("unproven"))
