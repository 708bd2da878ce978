"""Comparisons with the standing text, units, stages and courses over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import citations, text
from strandline.operators import annex
from strandline.plans.base import registry, table

QUERIES, SQL, query = registry()

#: A turn is the column that a unit prints, the turn before it the standing text; a conversation is the law.
_WORDS = r"list_filter(regexp_extract_all(lower({}), '\(anm\.\s*:[^)]*\)|\[\s*kommentar\s*:[^\]]*\]|§+\s*\d+[a-z]*\.?|\(\d+[a-z]*\)|\d+[a-z]?\.|\.\.\.|…|([\p{{L}}\p{{N}}§-]{{3,}})', 1), lambda x: x <> '')"
_COVER_SQL = f"""c AS (SELECT conv_id AS law, turn AS unit, text AS column_text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS standing FROM conversations),
w AS (SELECT law, unit, {_WORDS.format("column_text")} AS want, {_WORDS.format("standing")} AS have FROM c WHERE standing IS NOT NULL AND column_text IS NOT NULL),
v AS (SELECT law, unit, len(want) AS comparable, len(list_filter(want, lambda x: NOT list_contains(have, x))) AS missing FROM w)"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("law"), F.col("turn").alias("unit"), F.col("text").alias("column_text"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("standing"))
    return annex.coverage(c.where("standing IS NOT NULL AND column_text IS NOT NULL"), ["law", "unit"], "column_text", "standing")


@query(f"WITH {_COVER_SQL} SELECT law, unit, CAST(comparable AS INTEGER) AS comparable, CAST(missing AS INTEGER) AS missing, CASE WHEN comparable = 0 THEN 1 ELSE 1 - missing / comparable END AS ratio, comparable >= 5 AS prose FROM v")
def standing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of what a unit prints the standing text accounts for."""
    return _covered(spark, sf_dir)


@query(f"""WITH {_COVER_SQL}, j AS (SELECT law, count_if(comparable >= 5) AS judged, count_if(comparable >= 5 AND 1 - missing / comparable >= 0.95) AS verified FROM v GROUP BY 1)
SELECT law, judged, verified, CASE WHEN judged = 0 THEN 'unchecked' WHEN judged >= 3 AND verified / judged < 0.7 THEN 'doubtful' ELSE 'verified' END AS verdict FROM j""")
def law_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each law from its units: only a cluster of failures makes it doubtful."""
    return annex.law_verdicts(_covered(spark, sf_dir), "law")


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'elided' WHEN 1 THEN 'range' WHEN 2 THEN 'elided' END AS elision FROM part""")
def elisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two columns that only say what they leave out, and those where only the range differs."""
    k = F.col("p_partkey")
    kind, n = k % 5, (k % 40 + 2).cast("string")
    current = F.when(kind < 2, F.concat(F.lit("§ 5. (1) bis ("), n, F.lit(") …"))).when(kind == 2, F.concat("p_brand", F.lit(" (1) bis (3) ..."))).when(kind == 3, F.concat("p_brand", F.lit(" (1) …"))).otherwise(F.col("p_name"))
    proposed = F.when(kind == 0, F.concat(F.lit("§ 5. (1) bis ("), n, F.lit(") ..."))).when(kind == 1, F.concat(F.lit("§ 5. (1) bis (1"), n, F.lit(") …"))).when(kind == 2, current).when(kind == 3, F.concat(F.lit("other "), "p_brand", F.lit(" (1) …"))).otherwise(F.concat("p_name", F.lit(" …")))
    return table(spark, sf_dir, "part").select(k.alias("id"), annex.elision(current, proposed).alias("elision"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
q AS (SELECT *, length(line) - length(replace(replace(replace(replace(line, '"', ''), '„', ''), '“', ''), '”', '')) AS marks FROM l),
o AS (SELECT doc_id, pos, line, CASE WHEN length(line) < 30 AND coalesce(sum(marks) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 THEN 1 ELSE 0 END AS opens FROM q),
u AS (SELECT doc_id, pos, line, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit FROM o)
SELECT doc_id, CAST(unit AS BIGINT) AS unit, count(*) AS lines, arg_min(line, pos) AS first_line, CAST(sum(length(line)) AS BIGINT) AS chars FROM u GROUP BY 1, 2""")
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into units at short lines, which open none inside a quotation."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    units = annex.segmented(lines, ["doc_id"], "pos", "line", F.length("line") < 30)
    return units.groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("lines"), F.min_by("line", "pos").alias("first_line"), F.sum(F.length("line")).alias("chars"))


@query("""SELECT l_orderkey AS item, CAST(CAST(min(CASE WHEN l_returnflag = 'R' THEN (l_linenumber, l_shipdate) END)[2] AS DATE) AS VARCHAR) AS returned,
  CAST(CAST(min(CASE WHEN l_returnflag <> 'R' AND l_quantity > 30 THEN (l_linenumber, l_shipdate) END)[2] AS DATE) AS VARCHAR) AS decided FROM lineitem GROUP BY 1""")
def stage_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the first stages of two kinds in an item's record."""
    stages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.struct("l_linenumber", "l_shipdate").alias("pos"), "l_returnflag", "l_quantity", F.to_date("l_shipdate").cast("string").alias("day"))
    return annex.first_stage(stages, ["item"], "pos", "day", {"returned": F.col("l_returnflag") == "R", "decided": (F.col("l_returnflag") != "R") & (F.col("l_quantity") > 30)})


@query("""WITH e AS (SELECT user_id AS item, event_type AS state, row_number() OVER w AS n, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT * FROM e WHERE before IS NULL OR before <> state)
SELECT item, count(*) AS steps, count(*) - count(DISTINCT state) AS returns, arg_max(state, n) AS last_state FROM t GROUP BY 1""")
def item_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The course that each item's events tell: its steps without repeats, returns to an earlier state, where it stands."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), "ts", "event_id", F.col("event_type").alias("state"))
    return annex.courses(e, "item", ["ts", "event_id"], "state")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 3 THEN 'RV ' || o_orderkey || ' BlgNR ' || (CASE o_orderkey % 4 WHEN 0 THEN 28 WHEN 1 THEN 19 ELSE 14 END) || '. GP' END AS item,
  'Ministerialentwurf ' || o_orderkey || '/ME ' || (CASE o_orderkey % 4 WHEN 0 THEN 'XXVIII' WHEN 1 THEN 'XIX' WHEN 2 THEN 'XIV' ELSE 'IIX' END) || '. GP' AS draft FROM orders""")
def rendered_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and drafts as they are cited, periods in Arabic numerals; what is no numeral is not cited."""
    k = F.col("o_orderkey")
    period = F.when(k % 4 == 0, "XXVIII").when(k % 4 == 1, "XIX").when(k % 4 == 2, "XIV").otherwise("IIX")
    return table(spark, sf_dir, "orders").select(k.alias("id"), citations.cited_item("RV", F.concat(k.cast("string"), F.lit(" d.B.")), period).alias("item"), citations.cited_draft(F.concat(k.cast("string"), F.lit("/ME")), period).alias("draft"))


@query("""WITH n AS (SELECT p_brand AS record, p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN 2 WHEN p_size % 4 = 1 THEN 1 ELSE 0 END AS rank FROM part), b AS (SELECT record, max(rank) AS best FROM n GROUP BY 1)
SELECT record, id, rank FROM n JOIN b USING (record) WHERE rank = best AND best > 0""")
def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each record whose name says most firmly that they are its comparison."""
    size = F.col("p_size")
    name = F.when(size % 9 == 0, F.concat("p_name", F.lit(" Textgegenüberstellung.pdf"))).when(size % 4 == 1, F.concat("p_name", F.lit("_TGÜ.pdf"))).when(size % 4 == 2, F.concat("p_name", F.lit("_TGÜ_Erläuterungen.pdf"))).otherwise(F.concat("p_name", F.lit("_TGÜs.pdf")))
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("record"), F.col("p_partkey").alias("id"), name.alias("name"))
    return annex.best_ranked(p, ["record"], citations.name_rank(F.col("name"), "textgegenüberstellung", "TGÜ", "erläuterung")).select("record", "id", "rank")


@query("""SELECT p_partkey AS id, CAST(CASE WHEN p_size % 6 < 4 THEN p_size % 6 * 5 END AS BIGINT) AS number FROM part""")
def roman_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman numerals as numbers over a whole column; forms that are none are null."""
    numeral = F.element_at(F.array(*map(F.lit, ["", "V", "X", "XV", "IC", "VX"])), (F.col("p_size") % 6 + 1).cast("int"))
    value = text.roman(numeral)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(numeral == "", F.lit(0)).otherwise(value).cast("long").alias("number"))
