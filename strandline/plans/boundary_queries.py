"""Headings of packages against their drafts, and right columns against standing and drafted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import boundaries
from strandline.plans.base import registry, table

QUERIES, SQL, query = registry()

_ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX"]
#: An order is a package. Its draft has an article per line, numbered in Arabic (Roman in every seventh package, not at all in every
#: eleventh). Its annex prints headings of them: some left out, moved to the end, repeated, without number or title, or wrongly numbered.
PACKAGES_SQL = f"""l AS (SELECT l_orderkey AS package, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1 AS index, list_distinct(string_split(p_name || ' ' || lower(p_type) || ' of ' || (l_suppkey % 4), ' ')) AS words, l_quantity > 10 AS amends,
  l_linenumber AS kind, l_tax, l_discount, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT *, CASE WHEN package % 11 = 0 THEN NULL WHEN package % 7 = 0 THEN {_ROMAN}[index + 1] ELSE CAST(index + 1 AS VARCHAR) END AS numeral, CASE WHEN package % 13 = 0 THEN {_ROMAN}[index + 1] ELSE CAST(index + 1 AS VARCHAR) END AS printed,
  CASE WHEN l_returnflag = 'R' AND kind % 3 = 0 THEN 500 - index ELSE index * 10 END AS at0 FROM l),
h AS (SELECT package, at0 AS pos, CASE WHEN kind = 2 THEN NULL WHEN kind = 4 THEN CAST(index + 2 AS VARCHAR) ELSE printed END AS numeral, CASE WHEN kind = 3 THEN [] WHEN kind = 5 THEN words[1:1] ELSE words END AS words FROM n WHERE l_tax > 0.01
  UNION ALL SELECT package, at0 + 5, printed, words FROM n WHERE l_tax > 0.01 AND l_discount = 0.05)"""

_ACCEPTED_SQL = PACKAGES_SQL + """,
s AS (SELECT h.package, h.pos, n.index, n.amends, len(list_intersect(h.words, n.words)) / len(list_distinct(list_concat(h.words, n.words))) AS fits FROM h JOIN n ON h.package = n.package WHERE len(list_intersect(h.words, n.words)) > 0),
t AS (SELECT package, pos, CASE WHEN count(*) = 1 THEN min(index) END AS titled FROM (SELECT *, max(fits) OVER (PARTITION BY package, pos) AS best FROM s) WHERE fits = best AND best >= 0.6 GROUP BY 1, 2),
ta AS (SELECT package, pos, CASE WHEN count(*) = 1 THEN min(index) END AS titled FROM (SELECT *, max(fits) OVER (PARTITION BY package, pos) AS best FROM s WHERE amends) WHERE fits = best AND best >= 0.6 GROUP BY 1, 2),
c AS (SELECT h.*, t.titled, ta.titled AS titled_amending, n.index AS numbered, coalesce(s.fits, 0) AS fits, h.numeral SIMILAR TO '[IVXL]+' AND NOT (h.package % 7 = 0 AND h.package % 11 <> 0) AS alien FROM h LEFT JOIN t ON t.package = h.package AND t.pos = h.pos LEFT JOIN ta ON ta.package = h.package AND ta.pos = h.pos
  LEFT JOIN n ON n.package = h.package AND n.numeral = h.numeral LEFT JOIN s ON s.package = h.package AND s.pos = h.pos AND s.index = n.index),
d AS (SELECT package, pos, CASE WHEN numeral IS NULL THEN titled_amending WHEN alien THEN NULL WHEN numbered IS NULL THEN titled WHEN len(words) > 0 AND fits < 0.34 AND titled <> numbered THEN titled ELSE numbered END AS index,
  numeral IS NOT NULL AND numbered IS NOT NULL AND NOT coalesce(len(words) > 0 AND fits < 0.34 AND titled <> numbered, false) AND (len(words) = 0 OR fits < 0.34 OR titled IS NULL) AS bare FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY package, index ORDER BY pos) AS nth FROM d WHERE index IS NOT NULL),
a AS (SELECT package, pos, index FROM (SELECT *, max(index) OVER (PARTITION BY package ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM o WHERE nth = 1) WHERE NOT (bare AND furthest IS NOT NULL AND index <= furthest))"""
_VERDICT_SQL = _ACCEPTED_SQL + """,
k AS (SELECT DISTINCT a.package FROM a JOIN n x ON x.package = a.package AND x.amends AND x.index > a.index WHERE NOT EXISTS (SELECT 1 FROM n y WHERE y.package = a.package AND y.amends AND y.index > a.index AND y.index < x.index) AND NOT EXISTS (SELECT 1 FROM a b WHERE b.package = a.package AND b.index = x.index)),
g AS (SELECT package, count(*) AS articles, count(numeral) AS numbers, count_if(amends) AS amending, min(index) AS first, min(index) FILTER (amends) AS law FROM n GROUP BY 1),
r AS (SELECT g.*, (SELECT count(*) FROM a WHERE a.package = g.package) AS laws, EXISTS (SELECT 1 FROM h WHERE h.package = g.package AND numeral IS NOT NULL AND NOT numeral SIMILAR TO '[IVXL]+') AS asked, EXISTS (SELECT 1 FROM k WHERE k.package = g.package) AS skipped FROM g),
v AS (SELECT package, CASE WHEN laws > 0 THEN CASE WHEN skipped THEN 'skipped' ELSE 'divided' END WHEN asked AND numbers = 0 THEN 'undrafted' WHEN amending > 1 THEN 'undivided' ELSE 'whole' END AS verdict, laws, amending, articles, first, law FROM r),
z AS (SELECT package, verdict, CASE WHEN verdict = 'divided' THEN laws ELSE 0 END AS laws, CASE WHEN verdict = 'whole' THEN CASE WHEN amending = 1 THEN law WHEN articles = 1 THEN first END END AS whole FROM v)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``l`` of ``PACKAGES_SQL`` with the package's lines in order; words stay as name and type. A package is one row behind the shuffle, so all that is asked of its lines shares that shuffle."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linenumber", "l_tax", "l_discount", "l_returnflag", "p_name", "p_type")
    return lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("l")).select(F.col("l_orderkey").alias("package"), F.posexplode("l").alias("index", "l")).select("package", "index", "l.*")


def packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Articles (package, index, numeral, words, amends) and headings (package, pos, numeral, words) of ``PACKAGES_SQL``."""
    return _packages(_lines(spark, sf_dir))


def _packages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    words = F.array_distinct(F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("of"), (F.col("l_suppkey") % 4).cast("string")), " "))
    kept = lines.select("package", "index", words.alias("words"), (F.col("l_quantity") > 10).alias("amends"), F.col("l_linenumber").alias("kind"), "l_tax", "l_discount", "l_returnflag")
    package, index, kind = F.col("package"), F.col("index"), F.col("kind")
    # Past the twentieth article there is no numeral, as in the SQL.
    roman = F.get(F.array(*map(F.lit, _ROMAN)), index)
    arabic = (index + 1).cast("string")
    n = kept.withColumn("numeral", F.when(package % 11 == 0, None).when(package % 7 == 0, roman).otherwise(arabic)).withColumn("printed", F.when(package % 13 == 0, roman).otherwise(arabic))
    n = n.withColumn("place", F.when((F.col("l_returnflag") == "R") & (kind % 3 == 0), 500 - index).otherwise(index * 10))
    shown = n.where("l_tax > 0.01")
    number = F.when(kind == 2, None).when(kind == 4, (index + 2).cast("string")).otherwise(F.col("printed"))
    none = F.array().cast("array<string>")
    once = F.struct(F.col("place").cast("long").alias("pos"), number.alias("numeral"), F.when(kind == 3, none).when(kind == 5, F.slice("words", 1, 1)).otherwise(F.col("words")).alias("words"))
    again = F.struct((F.col("place") + 5).cast("long").alias("pos"), F.col("printed").alias("numeral"), F.col("words").alias("words"))
    headings = shown.select("package", F.explode(F.array_compact(F.array(once, F.when(F.col("l_discount") == 0.05, again)))).alias("h")).select("package", "h.*")
    return n.select("package", "index", "numeral", "words", "amends"), headings


@query(f"WITH {_ACCEPTED_SQL} SELECT package, pos, CAST(index AS INTEGER) AS index FROM a")
def law_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings that open a law, by number, title and printed order."""
    articles, headings = packages(spark, sf_dir)
    return boundaries.accepted(headings, articles, ["package"])


@query(f"WITH {_VERDICT_SQL} SELECT package, verdict, laws, CAST(whole AS INTEGER) AS whole FROM z")
def package_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a package's rows can be given to its laws, and why not."""
    articles, headings = packages(spark, sf_dir)
    return boundaries.resolved(headings, articles, ["package"])


@query(f"""WITH {_VERDICT_SQL}, w AS (SELECT n.package, n.index * 10 + CASE WHEN l_tax > 0.04 THEN 7 ELSE 0 END AS pos FROM n)
SELECT DISTINCT w.package, w.pos, CAST(CASE WHEN verdict = 'divided' THEN (SELECT arg_max(a.index, a.pos) FROM a WHERE a.package = w.package AND a.pos <= w.pos) WHEN verdict = 'whole' THEN whole END AS INTEGER) AS law FROM w JOIN z ON z.package = w.package""")
def rows_of_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of an annex with the law that the last standing heading before it opened."""
    lines = _lines(spark, sf_dir)
    articles, headings = _packages(lines)
    pos = F.col("index") * 10 + F.when(F.col("l_tax") > 0.04, 7).otherwise(0)
    rows = lines.select("package", pos.cast("long").alias("pos")).distinct()
    return boundaries.assigned(rows, headings, articles, ["package"])


#: A conversation's later turns are the rows of a comparison: the turn before it is the current column, half of the first turn and the
#: turn itself the proposed one; its first turn stands in force, its other even turns are the draft; every ninth right column is empty.
@query("""WITH t AS (SELECT conv_id AS law, turn AS pos, text, lag(text) OVER w AS current, first(text) OVER w AS opening FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
w0 AS (SELECT law, pos, current, CASE WHEN (law + pos) % 9 = 0 THEN '' WHEN pos % 3 = 1 THEN text ELSE text || ' ' || opening END AS proposed FROM t WHERE current IS NOT NULL),
w AS (SELECT law, pos, proposed, list_filter(regexp_extract_all(lower(current), '[\\p{L}\\p{N}§-]{3,}'), lambda x: x <> '') AS c, list_filter(regexp_extract_all(lower(proposed), '[\\p{L}\\p{N}§-]{3,}'), lambda x: x <> '') AS p FROM w0),
s AS (SELECT law, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}§-]{3,}'), ' ') AS standing FROM t WHERE pos = 0),
d AS (SELECT law, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (pos % 2 = 0 AND pos > 0), '') AS text FROM t GROUP BY 1), b AS (SELECT law, regexp_extract_all(lower(text), '[\\p{L}\\p{N}§-]{3,}') AS bag, regexp_matches(lower(text), 'entfällt|entfallen|aufgehoben|repealed') AS repeals FROM d),
x AS (SELECT law, pos, i, word FROM (SELECT law, pos, c, unnest(range(len(p))) AS i, unnest(p) AS word FROM w) WHERE NOT list_contains(c, word)),
g AS (SELECT law, pos, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS stretch FROM (SELECT *, i - row_number() OVER (PARTITION BY law, pos ORDER BY i) AS run FROM x) GROUP BY law, pos, run),
f AS (SELECT law, pos, bool_or(n >= 6 AND contains(' ' || standing || ' ', ' ' || stretch || ' ')) AS in_force FROM g JOIN s USING (law) GROUP BY 1, 2),
m AS (SELECT law, pos, count(*) AS new_words, count_if(NOT list_contains(bag, word)) AS missing FROM x JOIN b USING (law) GROUP BY 1, 2)
SELECT w.law, w.pos, coalesce(in_force, false) AS in_force, coalesce(new_words, 0) AS new_words, CAST(coalesce(missing, 0) AS BIGINT) AS missing, coalesce(new_words >= 10 AND missing >= 8 AND 1 - missing / new_words < 0.9, false) AS doubtful,
  trim(proposed) = '' AND len(c) > 0 AND NOT repeals AS unproven FROM w LEFT JOIN f ON f.law = w.law AND f.pos = w.pos LEFT JOIN m ON m.law = w.law AND m.pos = w.pos JOIN b ON b.law = w.law""")
def right_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of comparisons whose right column is in force already, says what no draft says, or repeals without proof."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = c.select(F.col("conv_id").alias("law"), F.col("turn").alias("pos"), "text", F.lag("text").over(w).alias("current"), F.first("text").over(w).alias("opening"))
    proposed = F.when((F.col("law") + F.col("pos")) % 9 == 0, "").when(F.col("pos") % 3 == 1, F.col("text")).otherwise(F.concat_ws(" ", "text", "opening"))
    rows = t.where("current IS NOT NULL").select("law", "pos", "current", proposed.alias("proposed"))
    drafted = F.sort_array(F.collect_list(F.when((F.col("pos") % 2 == 0) & (F.col("pos") > 0), F.struct("pos", "text"))))
    draft = t.groupBy("law").agg(F.array_join(F.transform(drafted, lambda x: x["text"]), " ").alias("text"))
    return boundaries.right_column(rows, t.where("pos = 0").select("law", "text"), draft, ["law"])
