"""Pages of two columns over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import layout
from strandline.plans.base import registry, table

QUERIES, SQL, query = registry()

WIDTH = 842.0
#: Every line of a document is a line of a page of forty: its first six words in the left column, the next six in the right one, at
#: offsets by the letters before them; every eleventh line's words begin in the middle as one run. Baselines wander by less than a point,
#: and the right column begins where a hash of the document says.
RUNS_SQL = r"""l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS said FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(doc_id || ':' || n), 1, 4) AS INTEGER) AS h, 415 + CAST('0x' || substr(md5(doc_id || ''), 1, 4) AS INTEGER) % 18 AS gutter, list_filter(string_split(said, ' '), lambda w: w <> '') AS ws FROM l),
w AS (SELECT doc_id, n, h, gutter, unnest(range(len(ws[1:12]))) AS i, unnest(ws[1:12]) AS word FROM h WHERE h % 11 > 0),
m AS (SELECT *, CASE WHEN i < 6 THEN 0 ELSE 1 END AS col, CASE WHEN h % 5 = 0 AND i IN (0, 6) THEN '(' || (h % 9 + 1) || ') ' ELSE '' END || word AS text FROM w),
r AS (SELECT doc_id, n // 40 AS page, CASE WHEN col = 0 THEN 40 ELSE gutter + 4 END + coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, n, col ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3.0 AS x, 780 - n % 40 * 14 + (h + i) % 3 * 0.4 AS y, length(text) * 3.0 AS width, text FROM m
  UNION ALL SELECT doc_id, n // 40, 300.0, 780 - n % 40 * 14, 240.0, array_to_string(ws[1:4], ' ') FROM h WHERE h % 11 = 0 AND len(ws) > 0),
s AS (SELECT doc_id, page, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, text FROM r)"""
_LINES_SQL = RUNS_SQL + """,
p AS (SELECT doc_id, x, least(464, CAST(ceil(x + width) AS INTEGER)) AS b, greatest(378, CAST(floor(x) AS INTEGER)) AS a FROM s), d AS (SELECT DISTINCT doc_id FROM s),
k AS (SELECT d.doc_id, g.pos, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id AND p.a <= g.pos AND g.pos <= p.b) AS ink FROM d, (SELECT unnest(range(378, 465)) AS pos) g),
c AS (SELECT doc_id, arg_min(pos, (ink, abs(pos - 421), pos)) AS border, min(ink) AS ink FROM k GROUP BY 1),
f AS (SELECT *, coalesce(CASE WHEN lag(y) OVER (PARTITION BY doc_id, page ORDER BY y DESC, x) - y > 2 THEN 1 ELSE 0 END, 0) AS falls FROM s),
v AS (SELECT f.*, CAST(sum(falls) OVER (PARTITION BY f.doc_id, page ORDER BY y DESC, x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line, CASE WHEN x < border AND x + width > border + 3 THEN 2 WHEN x + width / 2 < border THEN 0 ELSE 1 END AS side FROM f JOIN c ON c.doc_id = f.doc_id),
t AS (SELECT doc_id, page, line, coalesce(string_agg(text, ' ' ORDER BY x, text) FILTER (side = 0), '') AS left_text, coalesce(string_agg(text, ' ' ORDER BY x, text) FILTER (side = 1), '') AS right_text, coalesce(string_agg(text, ' ' ORDER BY x, text) FILTER (side = 2), '') AS spanning FROM v GROUP BY 1, 2, 3)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of ``RUNS_SQL``: doc_id, page, x, y, width, text."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "said"))
    hashed = lambda *c: F.conv(F.substring(F.md5(F.concat_ws(":", *c)), 1, 4), 16, 10).cast("int")
    lines = lines.select("doc_id", F.col("n").cast("long").alias("n"), hashed("doc_id", "n").alias("h"), (415 + hashed("doc_id") % 18).alias("gutter"), F.filter(F.split("said", " "), lambda w: w != "").alias("ws"))
    page, top = F.floor(F.col("n") / 40), 780 - F.col("n") % 40 * 14
    mark = lambda i: F.when((F.col("h") % 5 == 0) & i.isin(0, 6), F.concat(F.lit("("), (F.col("h") % 9 + 1).cast("string"), F.lit(") "))).otherwise("")
    words = F.transform(F.slice("ws", 1, 12), lambda w, i: F.concat(mark(i), w))
    # Where a word stands: the letters of its column's words before it, each with a blank.
    letters = lambda t, first, n: F.when(n > 0, F.length(F.array_join(F.slice(t, first, n), " ")) + 1).otherwise(0)
    before = lambda t, i: F.when(i < 6, letters(t, F.lit(1), i)).otherwise(letters(t, F.lit(7), i - 6))
    run = lambda x, y, width, text: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), text.alias("text"))
    two = F.transform("t", lambda w, i: run(F.when(i < 6, 40).otherwise(F.col("gutter") + 4) + before(F.col("t"), i) * 3.0, top + (F.col("h") + i) % 3 * 0.4, F.length(w) * 3.0, w))
    one = F.array(run(F.lit(300.0), top, F.lit(240.0), F.array_join(F.slice("ws", 1, 4), " ")))
    placed = F.when(F.col("h") % 11 > 0, two).when(F.size("ws") > 0, one)
    return lines.withColumn("t", words).select("doc_id", page.alias("page"), F.explode(placed).alias("r")).select("doc_id", "page", "r.*")


@query(f"WITH {_LINES_SQL} SELECT doc_id, CAST(border AS INTEGER) AS border, ink FROM c")
def column_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The border between the columns of each document's pages."""
    return layout.column_border(runs(spark, sf_dir), ["doc_id"], WIDTH)


@query(f"WITH {_LINES_SQL} SELECT doc_id, page, line, left_text, right_text, spanning FROM t")
def two_column_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every page, each with its left, right and spanning text."""
    found = layout.two_columns(runs(spark, sf_dir), ["doc_id"], ["page"], WIDTH)
    return found.select("doc_id", "page", "line", F.col("left").alias("left_text"), F.col("right").alias("right_text"), "spanning")


@query(rf"""WITH {_LINES_SQL}, o AS (SELECT *, CAST(spanning <> '' OR regexp_matches(left_text, '^\s*(§\s*\d+[a-z]?\.?|\(\d+[a-z]?\)|\d+[a-z]?\.|[a-z]\)|[a-z]{{2}}\))(\s|$)') OR regexp_matches(right_text, '^\s*(§\s*\d+[a-z]?\.?|\(\d+[a-z]?\)|\d+[a-z]?\.|[a-z]\)|[a-z]{{2}}\))(\s|$)') AS INTEGER) AS opens FROM t),
n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY doc_id ORDER BY page, line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row FROM o)
SELECT doc_id, row, coalesce(string_agg(spanning, ' ' ORDER BY page, line) FILTER (spanning <> ''), '') AS heading, md5(coalesce(string_agg(left_text, ' ' ORDER BY page, line) FILTER (left_text <> ''), '')) AS left_md5, md5(coalesce(string_agg(right_text, ' ' ORDER BY page, line) FILTER (right_text <> ''), '')) AS right_md5, count(*) AS lines FROM n GROUP BY 1, 2""")
def two_column_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the table that each document's pages print, over pages."""
    lines = layout.two_columns(runs(spark, sf_dir), ["doc_id"], ["page"], WIDTH)
    found = layout.table_rows(lines, ["doc_id"], ["page"])
    return found.select("doc_id", "row", "heading", F.md5("left").alias("left_md5"), F.md5("right").alias("right_md5"), "lines")
