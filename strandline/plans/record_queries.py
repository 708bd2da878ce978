"""Row decoders, nested records, stations and exact joins over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import stations
from strandline.plans.base import DRAFTS_SQL, drafts, registry, table
from strandline.sources import decoders

QUERIES, SQL, query = registry()


def _row(width: int, cells: dict[int, Column]) -> Column:
    """A positional row of strings."""
    return F.array(*[cells[i].cast("string") if i in cells else F.lit("") for i in range(width)])


def _url(kind: str, gp: str, inr: str) -> str:
    return f"'https://www.parlament.gv.at/gegenstand/' || {gp} || '/{kind}/' || {inr}"


@query(f"""WITH {DRAFTS_SQL} SELECT CAST(gp AS VARCHAR) AS gp, inr, inr || '/ME' AS citation, title || ' & more' AS title, CAST(ministry_code AS VARCHAR) AS ministry_code, ministry,
  CAST(arrived AS VARCHAR) AS arrived, CAST(deadline AS VARCHAR) AS deadline, status = 'O' AS active, CASE WHEN status <> 'P' THEN inr % 7 END AS statements,
  CASE WHEN inr % 2 = 0 THEN 'https://www.parlament.gv.at/x/' || inr ELSE {_url("ME", "gp", "inr")} END AS url FROM d""")
def draft_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional rows of the draft list as typed columns: markup, two spellings of a day, flags, counts, guarded addresses."""
    d = drafts(spark, sf_dir)
    even = F.col("inr") % 2 == 0
    cells = {
        0: F.col("gp"), 2: F.col("inr"), 3: F.date_format("arrived", "dd.MM.yyyy"), 4: F.concat(F.lit("<b>"), "title", F.lit("</b> &amp; more")), 5: F.concat(F.col("inr").cast("string"), F.lit("/ME")), 6: F.col("ministry_code"),
        7: F.when(even, F.concat(F.lit("/x/"), F.col("inr").cast("string"))).otherwise("http://elsewhere.example/x"), 10: F.when(even, F.col("arrived").cast("string")).otherwise("soon"), 11: F.when(F.col("status") == "O", "J").otherwise("N"),
        13: F.when(F.col("status") != "P", (F.col("inr") % 7).cast("string")).otherwise("n/a"), 14: F.date_format("deadline", "yyyyMMdd"), 16: F.col("ministry"),
    }
    rows = decoders.draft_rows(d.select(_row(17, cells).alias("row")), "row")
    return rows.withColumn("arrived", F.col("arrived").cast("string")).withColumn("deadline", F.col("deadline").cast("string"))


@query(f"""SELECT CAST(year(o_orderdate) AS VARCHAR) AS gp, o_orderkey AS inr, o_orderkey || ' d.B.' AS citation, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'RV' END AS kind,
  CASE WHEN o_orderstatus = 'F' THEN 'Law ' || o_orderkey || ' (EU)' ELSE 'Law ' || o_orderkey || ' (EU) (ÖVP, SPÖ)' END AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
  CAST(o_orderkey % 6 AS VARCHAR) AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 = 0 END AS vote_carried, {_url("I", "year(o_orderdate)", "o_orderkey")} AS url FROM orders""")
def item_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the item list; only a motion loses the clubs at its title's end and has a vote."""
    k, motion = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    cells = {
        0: F.year("o_orderdate"), 2: k, 6: F.concat(F.lit("Law "), k.cast("string"), F.lit(" (EU) (ÖVP, SPÖ)")), 7: F.concat(k.cast("string"), F.lit(" d.B.")), 8: F.date_format("o_orderdate", "yyyyMMdd"),
        10: k % 6, 11: F.when(motion, "A").otherwise("RV"), 12: F.when(k % 3 == 0, "1").otherwise("0"), 14: F.lit("//evil.example"),
    }
    return decoders.item_rows(table(spark, sf_dir, "orders").select(_row(15, cells).alias("row")), "row").withColumn("day", F.col("day").cast("string"))


@query("""SELECT s_suppkey || '/SN' AS citation, '2024-03-05' AS day, CASE WHEN s_suppkey % 5 = 0 THEN 'nonpublic' WHEN s_suppkey % 3 = 0 THEN 'organisation' ELSE 'person' END AS submitter_class,
  CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN s_name || ' GmbH' END AS organisation, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS endorsements,
  'https://www.parlament.gv.at/gegenstand/28/' || CASE WHEN s_suppkey % 4 = 0 THEN 'SPET' ELSE 'SNME' END || '/' || s_suppkey AS url FROM supplier""")
def statement_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the statement list: submitters classed at the scan, the number in brackets taken off, the flag may only veto."""
    k = F.col("s_suppkey")
    name = F.concat("s_name", F.when(k % 3 == 0, F.lit(" GmbH")).otherwise(""), F.lit(" ("), k.cast("string"), F.lit("/SN-126/ME)"))
    cells = {0: F.lit(28), 1: F.when(k % 4 == 0, "SPET").otherwise("?"), 2: k, 4: F.lit("05.03.2024"), 6: F.concat(F.lit('<a href="x">'), name, F.lit("</a>")), 12: F.when(k % 2 == 0, k.cast("string")).otherwise("-"), 15: F.concat(k.cast("string"), F.lit("/SN")), 19: F.when(k % 5 == 0, "P").otherwise("I")}
    return decoders.statement_rows(table(spark, sf_dir, "supplier").select(_row(20, cells).alias("row")), "row").withColumn("day", F.col("day").cast("string"))


@query("""SELECT '28' AS gp, 'ME' AS item_type, o_orderkey AS inr, o_orderpriority AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END AS statements, o_orderkey % 9 AS support, o_orderstatus = 'O' AS active FROM orders""")
def participation_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the participation list: a count that is no number is unread, not none."""
    k = F.col("o_orderkey")
    cells = {0: F.lit(28), 1: F.lit("ME"), 2: k, 11: F.col("o_orderpriority"), 19: F.when(k % 2 == 0, (k % 50).cast("string")).otherwise("viele"), 20: k % 9, 23: F.when(F.col("o_orderstatus") == "O", "J").otherwise("N")}
    return decoders.participation_rows(table(spark, sf_dir, "orders").select(_row(24, cells).alias("row")), "row")


@query("""SELECT p_partkey AS id, p_name AS title, CAST(p_size AS BIGINT) AS size, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_brand || '|' || p_type ELSE '' END AS bodies FROM part""")
def flattened_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as flat rows; what the source writes as one value, many or none becomes an array."""
    head = F.struct(F.col("p_partkey").alias("ID"), F.col("p_name").alias("Kurztitel"))
    size = F.struct(F.col("p_size").alias("Seiten"))
    one = F.to_json(F.struct(head.alias("Meta"), size.alias("Umfang"), F.col("p_brand").alias("Stelle")))
    many = F.to_json(F.struct(head.alias("Meta"), size.alias("Umfang"), F.array("p_brand", "p_type").alias("Stelle")))
    none = F.to_json(F.struct(head.alias("Meta"), size.alias("Umfang")))
    raw = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, one).when(F.col("p_partkey") % 3 == 1, many).otherwise(none).alias("json"))
    flat = decoders.flat_records(raw, "json", {"id": ("$.Meta.ID", "long"), "title": ("$.Meta.Kurztitel", "string"), "size": ("$.Umfang.Seiten", "long")}, {"bodies": "$.Stelle"})
    return flat.withColumn("bodies", F.array_join("bodies", "|"))


#: Bills of a draft are the order's lines, the house row and gazette entry of a bill come from the part and supplier it names.
_CHAIN_SQL = f"""{DRAFTS_SQL}, b AS (SELECT l_orderkey AS inr, max((l_shipdate, l_partkey)) AS l FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
h AS (SELECT p_partkey AS bill, CAST(p_size % 6 AS VARCHAR) AS status, CASE WHEN p_size > 40 THEN DATE '2024-01-01' END AS decided FROM part),
g AS (SELECT l_partkey AS bill, min((CAST(l_shipdate AS DATE), CAST(l_suppkey AS VARCHAR))) AS g FROM lineitem WHERE l_quantity > 45 GROUP BY 1),
c AS (SELECT d.gp, d.inr, b.l[2] AS bill, g.g[2] AS gazette, CASE WHEN b.l IS NULL THEN 'begutachtung' WHEN g.g IS NOT NULL THEN 'bgbl' WHEN h.decided IS NOT NULL OR h.status IN ('5', '4', '3') THEN 'parlament' ELSE 'rv' END AS station
  FROM d LEFT JOIN b USING (inr) LEFT JOIN h ON h.bill = b.l[2] LEFT JOIN g ON g.bill = b.l[2])"""


def _chains(spark: SparkSession, sf_dir: str, read_house: bool = True) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    bills = line.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("inr"), F.col("l_partkey").alias("bill"), F.col("l_shipdate").alias("linked_on"))
    house = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("bill"), (F.col("p_size") % 6).cast("string").alias("status"), F.when(F.col("p_size") > 40, F.lit("2024-01-01").cast("date")).alias("decided"))
    gazettes = line.where("l_quantity > 45").select(F.col("l_partkey").alias("bill"), F.to_date("l_shipdate").alias("issued"), F.col("l_suppkey").cast("string").alias("gazette"))
    return stations.chains(drafts(spark, sf_dir).select("gp", "inr", "arrived"), bills, house if read_house else None, gazettes, ["inr"], "bill")


@query(f"WITH {_CHAIN_SQL} SELECT inr, bill, gazette, station, true AS complete FROM c")
def station_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft, last linked bill, house row, earliest gazette entry, and the station they give."""
    return _chains(spark, sf_dir).select("inr", "bill", "gazette", "station", "complete")


@query(f"""WITH {_CHAIN_SQL} SELECT station, count(*) AS n, false AS complete FROM (SELECT CASE WHEN station = 'parlament' THEN 'rv' ELSE station END AS station FROM c) GROUP BY 1""")
def stations_without_house(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the house list unread: nothing is claimed that it would have had to say, and no chain is complete."""
    return _chains(spark, sf_dir, read_house=False).groupBy("station", "complete").agg(F.count(F.lit(1)).alias("n")).select("station", "n", "complete")


@query(f"""WITH {_CHAIN_SQL}, p AS (SELECT CAST(y AS INTEGER) AS gp, y < 1998 AS ended FROM range(1991, 2001) t(y))
SELECT p.gp, p.ended, CASE WHEN o.went IS NULL THEN 'unknown' WHEN o.went OR NOT p.ended THEN 'linked' ELSE 'unlinked' END AS coverage
FROM p LEFT JOIN (SELECT gp, bool_or(station <> 'begutachtung') AS went FROM c WHERE gp > 1992 OR station = 'begutachtung' GROUP BY 1) o USING (gp)""")
def period_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the links of a period exist at all: an ended one without any is unlinked, one without drafts unknown."""
    periods = spark.range(1991, 2001).select(F.col("id").cast("int").alias("gp"), (F.col("id") < 1998).alias("ended"))
    return stations.coverage(periods, _chains(spark, sf_dir).where("gp > 1992 OR station = 'begutachtung'"), "gp", "ended")


@query("""WITH r AS (SELECT o_orderkey AS record, CAST(o_orderdate AS DATE) AS issued, year(o_orderdate) AS gp, [o_custkey % 100, o_custkey % 37] AS items FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT gp, record, issued, unnest(items) AS item FROM r), f AS (SELECT gp, item, min((issued, record)) AS r FROM n GROUP BY 1, 2),
i AS (SELECT DISTINCT year(o_orderdate) AS gp, o_orderkey % 120 AS item FROM orders)
SELECT i.gp, i.item, f.r[2] AS record, CAST(f.r[1] AS VARCHAR) AS issued FROM i LEFT JOIN f ON f.gp = i.gp AND f.item = i.item""")
def gazette_of_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact join of items with gazette records that list them in an array, within a period; the earliest issue wins."""
    o = table(spark, sf_dir, "orders")
    gp = F.year("o_orderdate").cast("long").alias("gp")
    records = o.where("o_orderstatus = 'F'").select(gp, F.col("o_orderkey").alias("record"), F.to_date("o_orderdate").alias("issued"), F.array(F.col("o_custkey") % 100, F.col("o_custkey") % 37).alias("items"))
    items = o.select(gp, (F.col("o_orderkey") % 120).alias("item")).distinct()
    return stations.gazette_of(items, records, "item", "items", ["gp"]).select("gp", "item", "record", F.col("issued").cast("string").alias("issued"))


@query("""WITH i AS (SELECT o_orderkey AS item, o_custkey AS cited FROM orders), r AS (SELECT c_custkey AS item, CASE WHEN c_nationkey % 2 = 0 THEN 'report' ELSE c_mktsegment END AS kind, CASE WHEN c_nationkey % 4 = 0 THEN c_custkey - 1 END AS main FROM customer)
SELECT i.item, CASE WHEN a.kind = 'report' THEN i.cited END AS report, CASE WHEN a.kind = 'report' THEN a.main WHEN a.kind IS NOT NULL THEN i.cited END AS merged, CASE WHEN a.kind = 'report' THEN b.kind ELSE a.kind END AS kind
FROM i LEFT JOIN r a ON a.item = i.cited LEFT JOIN r b ON b.item = a.main""")
def merged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an item was merged: the item it cites, or the main item of the report it cites."""
    c = table(spark, sf_dir, "customer")
    records = c.select(F.col("c_custkey").alias("item"), F.when(F.col("c_nationkey") % 2 == 0, "report").otherwise(F.col("c_mktsegment")).alias("kind"), F.when(F.col("c_nationkey") % 4 == 0, F.col("c_custkey") - 1).alias("main"))
    return stations.merged_into(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("cited")), records)


@query(f"""WITH {_CHAIN_SQL} SELECT kind, n FROM (
  SELECT 'open' AS kind, count(*) AS n FROM d WHERE DATE '1998-06-01' BETWEEN arrived AND deadline UNION ALL
  SELECT 'closed ' || c.station, count(*) FROM c JOIN d USING (inr) WHERE NOT coalesce(DATE '1998-06-01' BETWEEN d.arrived AND d.deadline, false) GROUP BY c.station)""")
def dashboard_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open consultations on a day, and the closed ones by the station they reached: together every draft once."""
    day = F.lit("1998-06-01").cast("date")
    d = drafts(spark, sf_dir).select("inr", F.coalesce(day.between(F.col("arrived"), F.col("deadline")), F.lit(False)).alias("open"))
    kind = F.when(F.col("open"), "open").otherwise(F.concat(F.lit("closed "), "station"))
    return _chains(spark, sf_dir).join(d, "inr").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey AS part, count(*) AS versions, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, CAST(max(gap) AS BIGINT) AS longest FROM part LEFT JOIN (
  SELECT pk, day, coalesce(lead(day) OVER (PARTITION BY pk ORDER BY day) - day, 0) AS gap FROM (SELECT DISTINCT l_partkey AS pk, CAST(l_shipdate AS DATE) AS day FROM lineitem)) ON pk = p_partkey GROUP BY 1""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of each act: how many, from when to when, and the longest time that one stood."""
    from pyspark.sql import Window

    v = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("day")).distinct()
    v = v.withColumn("gap", F.coalesce(F.datediff(F.lead("day").over(Window.partitionBy("part").orderBy("day")), "day"), F.lit(0)))
    acts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    found = acts.join(v, "part", "left").groupBy("part").agg(F.count(F.lit(1)).alias("versions"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.max("gap").cast("long").alias("longest"))
    return found


@query(f"""WITH {_CHAIN_SQL}, s AS (SELECT l_orderkey AS inr, count(*) AS stages, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first_stage, count(DISTINCT l_suppkey) AS bodies FROM lineitem GROUP BY 1)
SELECT d.inr, d.title, d.ministry, CAST(d.deadline AS VARCHAR) AS deadline, c.station, c.bill, coalesce(s.stages, 0) AS stages, s.first_stage, coalesce(s.bodies, 0) AS bodies,
  count(*) OVER (PARTITION BY d.title) - 1 AS siblings FROM d JOIN c USING (inr) LEFT JOIN s USING (inr)""")
def draft_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detail view of every draft: its row, chain, stages, bodies that took part, and how many drafts share its title."""
    d = drafts(spark, sf_dir).select("inr", "title", "ministry", F.col("deadline").cast("string").alias("deadline"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("inr")).agg(F.count(F.lit(1)).alias("stages"), F.min(F.to_date("l_shipdate")).cast("string").alias("first_stage"), F.count_distinct("l_suppkey").alias("bodies"))
    siblings = d.groupBy("title").agg((F.count(F.lit(1)) - 1).alias("siblings"))
    joined = d.join(_chains(spark, sf_dir).select("inr", "station", "bill"), "inr").join(s, "inr", "left").join(siblings, "title")
    return joined.select("inr", "title", "ministry", "deadline", "station", "bill", F.coalesce("stages", F.lit(0)).alias("stages"), "first_stage", F.coalesce("bodies", F.lit(0)).alias("bodies"), "siblings")


@query("""SELECT c_custkey AS record, c_name AS title, 'begutachtung' AS station FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_acctbal > 0""")
def record_only_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that no draft is linked to, as rows of their own with the default station."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    linked = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(linked, "c_custkey", "left_anti").select(F.col("c_custkey").alias("record"), F.col("c_name").alias("title"), F.lit("begutachtung").alias("station"))


@query("""WITH u AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL), v AS (SELECT doc_id, n, n >= 2 AS deleted, n >= 3 AS moved FROM u)
SELECT doc_id, CAST(2 + CAST(n >= 3 AS INTEGER) AS BIGINT) AS touched, CAST(1 + CAST(n >= 2 AS INTEGER) + CAST(n >= 3 AS INTEGER) AS BIGINT) AS shown, CAST(1 - CAST(n >= 2 AS INTEGER) AS BIGINT) AS withheld FROM v""")
def consolidated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions applied to every document's units: the units they touch are shown, or withheld where refused, and the balance holds."""
    from strandline.operators import amend

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    trees = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("string").alias("path"), "text")
    lines = F.when(F.size(F.split("text", "\n")) >= 3, F.array(F.lit('In 1 replace the text by "New wording".'), F.lit("Delete 2."), F.lit("Delete 3."))).otherwise(F.array(F.lit('In 1 replace the text by "New wording".'), F.lit("Delete 2.")))
    todo = d.select("doc_id", F.posexplode(lines).alias("pos", "line"))
    verdicts = amend.apply_instructions(trees, todo, "doc_id").where("state = 'refused'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("withheld"))
    touched = todo.groupBy("doc_id").agg(F.count(F.lit(1)).alias("touched"))
    joined = touched.join(verdicts, "doc_id", "left").withColumn("withheld", F.coalesce("withheld", F.lit(0)))
    return joined.select("doc_id", "touched", (F.col("touched") - F.col("withheld")).alias("shown"), "withheld")
