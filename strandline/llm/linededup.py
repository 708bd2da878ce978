"""Line deduplication with edit distance 1 by deletion neighbourhoods.

Distinct lines first: each has the place of its first occurrence. Two different
lines are within one edit of each other exactly if deleting one character, or
none on one side, makes them equal; so lines emit a hashed key per variant and
equal keys join. Under one key, lines that lost the character at the same
position differ by one substitution at most, and all of them are one insertion
away from the line that is the variant itself. The least place per (key,
position) and per whole line therefore names an earlier partner without pairing
a group's members; its distance is verified.

Short lines (pairs whose shorter line is below ``SHORT`` characters) are varied
whole. For others, two exact filters keep the neighbourhoods small. One edit
leaves the first or the last half of the shorter line intact, so lines with
unique halves have no partner. Of ``PARTS`` parts of a line it leaves all but
one intact, so what is left meets under (text before, text after) a part, and
only the part between is varied; parts above ``DIRECT`` characters are cut again
in the same way, so that the work stays in proportion to a line's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import drop_table, joined_spread, let, materialize, rewritten

#: Lines below this many characters are varied whole.
SHORT = 12
#: Parts of a line for the second filter.
PARTS = 16
#: Parts of up to this many characters are varied.
DIRECT = 64


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of id and text), line_no and trimmed line of every line that has a word."""
    split = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.withColumn("line", trimmed(F.col("line"))).where("line <> ''")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def line_id(line: Column) -> tuple[Column, Column]:
    """128 bits that stand for a line's text."""
    return F.xxhash64(line), F.xxhash64(F.lit("line"), line)


def halves(line: Column, n: Column) -> list[Column]:
    """Keys of the first and last half, for the line as the shorter and as the longer one of a pair."""
    sizes = [F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")]
    return [key for k in sizes for key in (F.xxhash64(F.lit("head"), k, F.substring(line, F.lit(1), k)), F.xxhash64(F.lit("tail"), k, F.right(line, k)))]


def parts(line: Column, n: Column, longer: Column) -> Column:
    """For each part of a text of ``n`` characters: the hash of what stands before and after it, and the part.

    A text meets texts of its own length; as the longer one of a pair it is cut
    as the shorter one is, its part has one character more.
    """
    size = n - longer.cast("int")

    def one(j: Column) -> Column:
        begin, end = F.floor(size * j / PARTS).cast("int"), F.floor(size * (j + 1) / PARTS).cast("int")
        tail = F.right(line, size - end)
        return F.struct(F.xxhash64(size, j, F.substring(line, F.lit(1), begin), F.lit("\0"), tail).alias("frame"), F.substring(line, begin + 1, n - begin - (size - end)).alias("part"))

    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), one)


def shortened(part: Column) -> Column:
    """(key, position) of each variant of ``part`` with one character deleted."""
    n = F.char_length(part)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.xxhash64(F.concat(F.substring(part, F.lit(1), i - 1), F.substring(part, i + 1, n))).alias("key"), i.alias("position")))
    return F.when(n > 0, cut).otherwise(F.filter(cut, lambda _: F.lit(False)))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two texts are at most one edit apart, in n log n: their common prefix by bisection, then what follows it."""
    n = F.least(F.char_length(a), F.char_length(b))

    def halved(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"] + 1) / 2).cast("int")
        same = F.left(a, middle) == F.left(b, middle)
        return F.struct(F.when(same, middle).otherwise(state["lo"]).alias("lo"), F.when(same, state["hi"]).otherwise(middle - 1).alias("hi"))

    # A round halves what is open, also where nothing is: the bounds then stay.
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    begin = F.struct(F.lit(0).alias("lo"), n.alias("hi"))
    open_or_done = lambda state, i: F.when(state["lo"] < state["hi"], halved(state, i)).otherwise(state)
    prefix = F.aggregate(rounds, begin, open_or_done)["lo"]
    more = F.char_length(a) - F.char_length(b)
    rest = lambda t, k: F.right(t, F.greatest(F.char_length(t) - k, F.lit(0)))
    return let(prefix, lambda p: F.when(more == 0, rest(a, p + 1) == rest(b, p + 1)).when(more == 1, rest(a, p + 1) == rest(b, p)).when(more == -1, rest(a, p) == rest(b, p + 1)).otherwise(F.lit(False)))


def candidate_texts(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2, place and text of the distinct lines that share a half with another line."""
    keys = distinct.where(f"n >= {SHORT}").select("h1", "h2", F.explode(F.array_distinct(F.array("k0", "k1", "k2", "k3"))).alias("half")).where("half IS NOT NULL")
    met = keys.groupBy("half").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    candidates = joined_spread(keys, met, ["half"], "members").select("h1", "h2").distinct()
    firsts = materialize(candidates.join(distinct.select("h1", "h2", "first"), ["h1", "h2"]).select("h1", "h2", "first.*"), "candidates")
    # The texts come from the documents that hold the first occurrences.
    # Merged at any size: few candidates must not be broadcast while they are few and shuffled once they are many.
    holders = firsts.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct().hint("merge")
    held = docs.select("doc_id", "text").withColumn("_row", F.xxhash64("doc_id", "text"))
    texts = held.join(holders, held["doc_id"].eqNullSafe(holders["_id"]) & (held["_row"] == holders["_mark"]), "left_semi")
    g1, g2 = line_id(F.col("line"))
    found = lines_of(texts).select(g1.alias("h1"), g2.alias("h2"), F.col("mark").alias("_mark"), F.col("line_no").alias("_line_no"), "line")
    same = found.join(firsts, ["h1", "h2"]).where("_mark = mark AND _line_no = line_no").dropDuplicates(["h1", "h2"])
    return materialize(same.select("h1", "h2", F.struct("doc_id", "mark", "line_no").alias("place"), "line"), "texts")


def met_frames(frames: DataFrame) -> DataFrame:
    """The rows of ``frames`` whose frame has another member, one of them not the longer one of a pair."""
    met = frames.groupBy("frame").agg(F.count(F.lit(1)).alias("members"), F.min("longer").alias("least")).where("members > 1 AND NOT least").select("frame", "members")
    return joined_spread(frames, met, ["frame"], "members").drop("members")


def framed(texted: DataFrame) -> DataFrame:
    """h1, h2, place, longer, frame and part (at most ``DIRECT`` characters and one) of all lines that may meet another one there."""
    columns = ["h1", "h2", "place", "longer", "p.*"]
    n, longer = F.char_length("line"), F.col("longer")
    sides = texted.select("h1", "h2", "place", "line", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")).where(n - longer.cast("int") >= SHORT)
    frames = materialize(met_frames(sides.select("h1", "h2", "place", "longer", F.explode(parts(F.col("line"), n, longer)).alias("p")).select(*columns)), "frames")
    # A part is at most a PARTS-th of the text that it was cut from: few rounds even for the longest lines.
    wide = F.char_length("part") > DIRECT + 1
    while frames.where(wide).limit(1).count():
        part = parts(F.col("part"), F.char_length("part"), longer)
        deeper = frames.where(wide).select("h1", "h2", "place", "longer", F.col("frame").alias("outer"), F.explode(part).alias("p"))
        deeper = deeper.select("h1", "h2", "place", "longer", F.xxhash64("outer", "p.frame").alias("frame"), "p.part")
        cut = materialize(frames.where(~wide).unionByName(met_frames(deeper)), "frames")
        drop_table(frames)
        frames = cut
    return frames


def earlier_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct lines (h1, h2, first, members) and, of them, those with an earlier line one edit away (h1, h2, earlier).

    ``first`` and ``earlier`` are places: structs (doc_id, mark, line_no).
    """
    h1, h2 = line_id(F.col("line"))
    n = F.char_length("line")
    keys = [f"k{i}" for i in range(4)]
    marked = lines_of(docs).select(
        h1.alias("h1"), h2.alias("h2"), F.struct("doc_id", "mark", "line_no").alias("place"), n.alias("n"), F.when(n <= SHORT, F.col("line")).alias("line"),
        *(F.when(n - int(i > 1) >= SHORT, k).alias(name) for i, (name, k) in enumerate(zip(keys, halves(F.col("line"), n), strict=True))),
    )
    distinct = materialize(marked.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("members"), *(F.min(c).alias(c) for c in ["n", "line", *keys])), "lines")
    texted = candidate_texts(docs, distinct)
    # Short lines need no filter: each has at most SHORT variants. Their frame is their length.
    short = distinct.where("line IS NOT NULL").select("h1", "h2", F.col("first").alias("place"), "line", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    size = F.char_length("line") - F.col("longer").cast("int")
    short = short.where((size < SHORT) & (size > 0)).select("h1", "h2", "place", "longer", size.cast("long").alias("frame"), F.col("line").alias("part"))
    frames = framed(texted).unionByName(short)
    # Substitutions: lines of one length whose parts lost the character at one position.
    equal = frames.where("NOT longer")
    lost = equal.select("h1", "h2", "place", "frame", F.explode(shortened(F.col("part"))).alias("v")).select("h1", "h2", "place", "frame", "v.*")
    # They differ in that character alone, so a group has no more lines than there are characters: no key is hot.
    least = lost.groupBy("frame", "key", "position").agg(F.min("place").alias("other"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    swaps = lost.join(least, ["frame", "key", "position"]).select("h1", "h2", "place", "other")
    # Insertions: a variant of the longer line's part is the shorter line's part.
    whole = equal.select("frame", F.xxhash64("part").alias("key"), F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("place").alias("short_place"))
    longer = frames.where("longer").select("h1", "h2", "place", "frame", F.explode(F.array_distinct(F.transform(shortened(F.col("part")), lambda v: v["key"]))).alias("key"))
    # Distinct lines: a (frame, part) has one owner, so this join is at most a row per variant.
    pairs = longer.join(whole, ["frame", "key"])
    inserted = pairs.select("h1", "h2", "place", F.col("short_place").alias("other"))
    removed = pairs.groupBy(F.col("s1").alias("h1"), F.col("s2").alias("h2")).agg(F.min("short_place").alias("place"), F.min("place").alias("other"))
    links = swaps.unionByName(inserted).unionByName(removed).where("other < place").groupBy("h1", "h2").agg(F.min("other").alias("earlier"))
    texts = texted.select("h1", "h2", "place", "line").unionByName(distinct.where(f"n < {SHORT}").select("h1", "h2", F.col("first").alias("place"), "line"))
    # A line of SHORT characters has a text here even if it shares no half with another one.
    texts = texts.unionByName(distinct.where(f"n = {SHORT}").select("h1", "h2", F.col("first").alias("place"), "line")).dropDuplicates(["h1", "h2"])
    mine = texts.select("h1", "h2", "line").join(links, ["h1", "h2"])
    partner = texts.select(F.col("place").alias("earlier"), F.col("line").alias("other_line"))
    checked = mine.join(partner, "earlier").where(one_edit(F.col("line"), F.col("other_line")))
    return distinct.select("h1", "h2", "first", "members"), checked.select("h1", "h2", "earlier")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines to drop: doc_id, mark, line_no of each that has an earlier occurrence or an earlier line one edit away.

    Places are ordered by doc_id (null first), hash of the row, and line number.
    Blank lines are never dropped; null texts and empty tables have no lines.
    """
    firsts, near = earlier_lines(docs)
    verdict = materialize(firsts.join(near.select("h1", "h2", F.lit(True).alias("near")), ["h1", "h2"], "left").where("near OR members > 1"), "verdicts")
    lines = lines_of(docs)
    h1, h2 = line_id(F.col("line"))
    places = lines.select(h1.alias("h1"), h2.alias("h2"), "doc_id", "mark", "line_no", F.struct("doc_id", "mark", "line_no").alias("place"))
    # A line that a third of all documents have is one row of the verdicts: places do not gather under it.
    return joined_spread(places, verdict, ["h1", "h2"], "members").where("near OR place <> first").select("doc_id", "mark", "line_no")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines: the same columns, ``text`` and ``n_chars`` (if there) of what is left.

    Every row stays; a text whose lines all go becomes empty, null stays null.
    Identical rows are one place in the order and lose the same lines. Columns
    other than doc_id, text and n_chars pass through, whatever their names.
    """
    gone = repeated_lines(docs).groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias("gone"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("doc_id", "text").alias("row_mark"))
    joined = rows.join(gone, rows["row.doc_id"].eqNullSafe(gone["doc_id"]) & (rows["row_mark"] == gone["mark"]), "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    joined = joined.select("row", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept).alias("left_text"))
    return joined.select(*rewritten(docs, F.col("row"), F.col("left_text")))


def line_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines (with a word), dropped (numbers of the lines that go, from 0, in order).

    Null and empty texts have no lines; identical rows lose the same lines; other columns are ignored.
    """
    marked = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: trimmed(x) != "")).cast("long").alias("n_lines"))
    gone = repeated_lines(docs).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))
    joined = marked.join(gone, marked["doc_id"].eqNullSafe(gone["_id"]) & (marked["mark"] == gone["_mark"]), "left")
    return joined.select("doc_id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


#: ``line_report`` of ``documents``, whose ids are distinct.
ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT doc_id, line_no, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l
), o AS (
  SELECT * FROM t WHERE line <> ''
), d AS (
  SELECT line, min((doc_id, line_no)) AS place FROM o GROUP BY line
), v AS (
  SELECT line, place, i, hash(left(line, i - 1) || substring(line, i + 1)) AS h FROM (SELECT line, place, unnest(range(1, length(line) + 1)) AS i FROM d)
), near AS (
  SELECT a.line, b.place AS other FROM v a JOIN (SELECT i, h, min(place) AS place FROM v GROUP BY i, h) b ON a.i = b.i AND a.h = b.h WHERE b.place < a.place
  UNION ALL SELECT v.line, d.place FROM v JOIN d ON v.h = hash(d.line) WHERE d.place < v.place
  UNION ALL SELECT d.line, v.place FROM v JOIN d ON v.h = hash(d.line) WHERE v.place < d.place
), gone AS (
  SELECT o.doc_id, o.line_no FROM o JOIN d USING (line) WHERE (o.doc_id, o.line_no) <> d.place OR o.line IN (SELECT line FROM near)
)
SELECT k.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.dropped, []) AS dropped FROM documents k
LEFT JOIN (SELECT doc_id, count(*) AS n FROM o GROUP BY 1) n USING (doc_id) LEFT JOIN (SELECT doc_id, list(CAST(line_no AS INTEGER) ORDER BY line_no) AS dropped FROM gone GROUP BY 1) g USING (doc_id)
"""
