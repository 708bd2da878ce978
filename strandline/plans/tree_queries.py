"""Trees of marked lines over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import trees
from strandline.plans.base import registry, table

QUERIES, SQL, query = registry()

#: Every line of every document, under a marker that a hash of document and place picks (two of seven lines have none).
LINES_SQL = r"""raw AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS said FROM documents WHERE text IS NOT NULL),
kinds AS (SELECT doc_id, pos, said, CAST('0x' || substr(md5(doc_id || ':' || pos), 1, 4) AS INTEGER) AS h FROM raw),
lines AS (SELECT doc_id, pos, CASE h % 7 WHEN 0 THEN '§ ' || (h % 90 + 1) || '. ' WHEN 1 THEN '(' || (h % 9 + 1) || ') ' WHEN 2 THEN (h % 12 + 1) || '. ' WHEN 3 THEN chr(97 + CAST(h % 26 AS INTEGER)) || ') ' WHEN 4 THEN repeat(chr(97 + CAST(h % 26 AS INTEGER)), 2) || ') ' ELSE '' END || said AS line FROM kinds)"""

_TREE_SQL = LINES_SQL + r""",
m AS (SELECT doc_id, pos, line, CASE WHEN regexp_matches(line, '^\s*§\s*\d+[a-z]?\.?(\s|$)') THEN 0 WHEN regexp_matches(line, '^\s*\(\d+[a-z]?\)(\s|$)') THEN 1 WHEN regexp_matches(line, '^\s*\d+[a-z]?\.(\s|$)') THEN 2
  WHEN regexp_matches(line, '^\s*[a-z]\)(\s|$)') THEN 3 WHEN regexp_matches(line, '^\s*[a-z]{2}\)(\s|$)') THEN 4 ELSE 5 END AS level FROM lines),
i AS (SELECT *, CASE WHEN level < 5 THEN regexp_extract(line, '^\s*[§(]?\s*([0-9a-z]+)', 1) ELSE '' END AS id FROM m),
p AS (SELECT a.doc_id, a.pos, a.line, a.level, a.id, max(b.pos) AS parent FROM i a LEFT JOIN i b ON b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level GROUP BY ALL),
t AS (SELECT doc_id, pos, level, id, line, parent, 0 AS depth, [{'level': level, 'id': id, 'pos': pos}] AS path FROM p WHERE parent IS NULL
  UNION ALL SELECT p.doc_id, p.pos, p.level, p.id, p.line, p.parent, t.depth + 1, list_append(t.path, {'level': p.level, 'id': p.id, 'pos': p.pos}) FROM p JOIN t ON t.doc_id = p.doc_id AND t.pos = p.parent)"""
_ADDRESS = "array_to_string(list_transform(list_filter(path, lambda x: x.level < 5), lambda x: CASE x.level WHEN 0 THEN '§' || x.id WHEN 1 THEN '(' || x.id || ')' WHEN 2 THEN x.id || '.' ELSE x.id || ')' END), '/')"


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ``LINES_SQL``: doc_id, pos, line."""
    raw = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "said"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "pos")), 1, 4), 16, 10).cast("int")
    raw = raw.withColumn("h", h)
    letter = F.char(97 + F.col("h") % 26)
    kinds = [F.concat(F.lit("§ "), (F.col("h") % 90 + 1).cast("string"), F.lit(". ")), F.concat(F.lit("("), (F.col("h") % 9 + 1).cast("string"), F.lit(") ")), F.concat((F.col("h") % 12 + 1).cast("string"), F.lit(". ")), F.concat(letter, F.lit(") ")), F.concat(letter, letter, F.lit(") "))]
    marker = F.coalesce(*[F.when(F.col("h") % 7 == i, kind) for i, kind in enumerate(kinds)], F.lit(""))
    return raw.select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat(marker, "said").alias("line"))


@query(f"WITH RECURSIVE {_TREE_SQL} SELECT doc_id, pos, CAST(level AS INTEGER) AS level, id, parent, {_ADDRESS} AS address, CAST(depth AS INTEGER) AS depth FROM t")
def paragraph_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's place in its document's tree: level and designation, the line above it, its address."""
    nodes = trees.tree(marked_lines(spark, sf_dir), ["doc_id"], "pos", "line")
    return nodes.select("doc_id", "pos", "level", "id", "parent", trees.address(F.col("path")).alias("address"), "depth")


@query(f"WITH {LINES_SQL} SELECT doc_id, md5(string_agg(trim(line), chr(10) ORDER BY pos)) AS text_md5, CAST(count(*) AS INTEGER) AS lines FROM lines GROUP BY 1")
def rendered_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees rendered: every document's lines come back as they were."""
    lines = marked_lines(spark, sf_dir).withColumn("line", F.trim("line"))
    whole = trees.rendered(trees.tree(lines, ["doc_id"], "pos", "line"), ["doc_id"])
    return whole.select("doc_id", F.md5("text").alias("text_md5"), "lines")


@query(rf"""WITH RECURSIVE {_TREE_SQL}, d AS (SELECT doc_id, path[1].pos AS top, path[1].level AS top_level, pos, line, regexp_replace(line, '^\s*(§\s*\d+[a-z]?\.?|\(\d+[a-z]?\)|\d+[a-z]?\.|[a-z]\)|[a-z]{{2}}\))(\s+|$)', '') AS body FROM t)
SELECT doc_id, top AS pos, md5(coalesce(string_agg(trim(body), ' ' ORDER BY pos) FILTER (trim(body) <> ''), '')) AS plain_md5, CAST(count(*) AS INTEGER) AS lines FROM d WHERE top_level = 0 GROUP BY 1, 2""")
def paragraph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each paragraph with all below it, without markers, as comparisons read it."""
    texts = trees.rendered(trees.tree(marked_lines(spark, sf_dir), ["doc_id"], "pos", "line"), ["doc_id"], level=0)
    return texts.select("doc_id", "pos", F.md5("plain").alias("plain_md5"), "lines")


@query(f"WITH RECURSIVE {_TREE_SQL}, a AS (SELECT doc_id, {_ADDRESS} AS address, pos FROM t WHERE level < 5) SELECT doc_id, address, min(pos) AS pos FROM a GROUP BY 1, 2 HAVING count(*) = 1")
def unique_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses that name one node of a document alone."""
    return trees.by_address(trees.tree(marked_lines(spark, sf_dir), ["doc_id"], "pos", "line"), ["doc_id"])
