"""List queries over the draft view of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import dates, text
from strandline.operators import lists
from strandline.plans.base import DRAFTS_SQL, drafts, registry, table

QUERIES, SQL, query = registry()
DAY = "1998-06-01"


def _day():
    return F.lit(DAY).cast("date")


def _open(df: DataFrame) -> DataFrame:
    return df.withColumn("active", dates.open_on(F.col("arrived"), F.col("deadline"), _day()))


_OPEN_SQL = f"WITH {DRAFTS_SQL}, o AS (SELECT *, coalesce(DATE '{DAY}' BETWEEN arrived AND deadline, false) AS active FROM d)"


@query(f"""{_OPEN_SQL}
SELECT CAST(pos AS INTEGER) AS pos, gp, inr, title, ministry, CAST(arrived AS VARCHAR) AS arrived, CAST(deadline AS VARCHAR) AS deadline, active FROM (
  SELECT *, row_number() OVER (ORDER BY active DESC, CASE WHEN active THEN deadline END ASC NULLS LAST,
    CASE WHEN active AND deadline IS NULL THEN arrived END DESC NULLS LAST,
    CASE WHEN NOT active THEN coalesce(deadline, arrived) END DESC NULLS LAST, inr) AS pos FROM o)
WHERE pos <= 100""")
def drafts_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of the draft list in its two-block order."""
    df = _open(drafts(spark, sf_dir))
    return lists.page(df, lists.two_block_order("active", "deadline", "arrived", ["inr"]), 100).select("pos", "gp", "inr", "title", "ministry", F.col("arrived").cast("string").alias("arrived"), F.col("deadline").cast("string").alias("deadline"), "active")


@query(f"""{_OPEN_SQL}
SELECT CAST(pos AS INTEGER) AS pos, inr, active FROM (
  SELECT *, row_number() OVER (ORDER BY active DESC, CASE WHEN active THEN deadline END DESC NULLS LAST,
    CASE WHEN active AND deadline IS NULL THEN arrived END ASC NULLS LAST,
    CASE WHEN NOT active THEN coalesce(deadline, arrived) END ASC NULLS LAST, inr) AS pos FROM o)
WHERE pos > 50 AND pos <= 100""")
def drafts_list_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of 50 with the dates reversed inside the blocks."""
    df = _open(drafts(spark, sf_dir))
    return lists.page(df, lists.two_block_order("active", "deadline", "arrived", ["inr"], reverse=True), 50, 1).select("pos", "inr", "active")


@query(f"""{_OPEN_SQL}
SELECT gp, status, count(*) AS n FROM o WHERE active OR status = 'P' GROUP BY ALL""")
def filter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open drafts, or those that still take filings (status P), counted by period and status."""
    df = _open(drafts(spark, sf_dir)).where(F.col("active") | (F.col("status") == "P"))
    return df.groupBy("gp", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DRAFTS_SQL}, chain AS (
  SELECT l_orderkey AS inr, min(CASE WHEN l_linestatus = 'F' THEN 'gazette' ELSE 'parliament' END) AS station FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT coalesce(station, 'consultation') AS station, count(*) AS n FROM d LEFT JOIN chain USING (inr)
WHERE coalesce(station, 'consultation') IN ('consultation', 'gazette') GROUP BY 1""")
def filter_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts by station; a draft without a chain is in consultation."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    chain = lines.groupBy(F.col("l_orderkey").alias("inr")).agg(F.min(F.when(F.col("l_linestatus") == "F", "gazette").otherwise("parliament")).alias("station"))
    df = drafts(spark, sf_dir).join(chain, "inr", "left").withColumn("station", F.coalesce("station", F.lit("consultation")))
    return df.where(F.col("station").isin("consultation", "gazette")).groupBy("station").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT l_orderkey AS inr, min(l_suppkey) AS lead, list_sort(list(DISTINCT l_suppkey)) AS all_keys, min(l_linenumber) AS first_pos FROM lineitem GROUP BY 1)
SELECT inr, lead, array_to_string(all_keys[2:], ',') AS co, CAST(first_pos AS INTEGER) AS first_pos FROM f WHERE lead % 10 = 3 OR len(list_filter(all_keys[2:], lambda x: x % 10 = 3)) > 0""")
def filter_lead_or_co(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint drafts folded to one row (lead body, co-bodies), kept if a body in question leads or joins."""
    folded = lists.fold_joint(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "inr"), ["inr"], "l_suppkey", "l_linenumber")
    hit = (F.col("lead") % 10 == 3) | F.exists("co", lambda x: x % 10 == 3)
    return folded.where(hit).select("inr", "lead", F.array_join(F.transform("co", lambda x: x.cast("string")), ",").alias("co"), "first_pos")


@query("""SELECT CASE WHEN l.doc_id IS NULL THEN 'unread' WHEN l.toxic = 1 THEN 'yes' ELSE 'none' END AS marker, count(*) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def filter_three_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marker that was read and is set, was read and is not, or was never read: three classes, none of them merged."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    side = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(True).alias("is_read"))
    marker = F.when(F.col("is_read").isNull(), "unread").when(F.col("toxic") == 1, "yes").otherwise("none")
    return docs.join(side, "doc_id", "left").groupBy(marker.alias("marker")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DRAFTS_SQL} SELECT gp, inr, title FROM d WHERE contains(lower(title || ' ' || ministry), 'customer') AND contains(lower(title || ' ' || ministry), '77') AND contains(lower(title || ' ' || ministry), '1')""")
def filter_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AND of query tokens over title and ministry."""
    df = drafts(spark, sf_dir)
    return df.where(text.matches_all(text.haystack(F.col("title"), F.col("ministry")), "customer 77 1")).select("gp", "inr", "title")


@query(f"""WITH {DRAFTS_SQL} SELECT ministry, count(*) AS n, CAST(min(arrived) AS VARCHAR) AS first_day, CAST(max(arrived) AS VARCHAR) AS last_day FROM d WHERE arrived >= DATE '1998-01-15' AND arrived <= DATE '1998-03-31' GROUP BY 1""")
def filter_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive day window, then a tally by ministry."""
    df = drafts(spark, sf_dir).where(dates.in_window(F.col("arrived"), F.lit("1998-01-15").cast("date"), F.lit("1998-03-31").cast("date")))
    return df.groupBy("ministry").agg(F.count(F.lit(1)).alias("n"), F.min("arrived").cast("string").alias("first_day"), F.max("arrived").cast("string").alias("last_day"))


@query(f"""WITH {DRAFTS_SQL} SELECT kind, count(*) AS n, min(key) AS first_key FROM (
  SELECT 'draft' AS kind, 'd' || inr AS key, arrived AS day FROM d UNION ALL
  SELECT 'act' AS kind, 'a' || p_partkey AS key, NULL AS day FROM part UNION ALL
  SELECT 'body' AS kind, 'b' || s_suppkey AS key, NULL AS day FROM supplier) GROUP BY 1""")
def union_of_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several kinds in one list: a kind, one key, one order key, the rest null."""
    d = drafts(spark, sf_dir).select(F.lit("draft").alias("kind"), F.concat(F.lit("d"), "inr").alias("key"), F.col("arrived").alias("day"))
    a = table(spark, sf_dir, "part").select(F.lit("act").alias("kind"), F.concat(F.lit("a"), "p_partkey").alias("key"))
    b = table(spark, sf_dir, "supplier").select(F.lit("body").alias("kind"), F.concat(F.lit("b"), "s_suppkey").alias("key"))
    every = d.unionByName(a, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


@query(f"""WITH {DRAFTS_SQL} SELECT gp, count(*) AS n FROM d WHERE gp = 1998 OR (gp = 1997 AND deadline >= DATE '1998-01-10') GROUP BY 1""")
def carry_over_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current period and the previous period's rows whose deadline still runs."""
    df = drafts(spark, sf_dir)
    both = lists.carry_over(df.where("gp = 1998"), df.where("gp = 1997"), "deadline", F.lit("1998-01-10").cast("date"))
    return both.groupBy("gp").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority AS priority, bool_or(has_line) AS any_linked, count(*) AS n, count_if(has_line) AS linked, count_if(NOT has_line) AS unlinked FROM (
  SELECT o_orderpriority, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_line FROM orders) GROUP BY 1""")
def semi_and_anti_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with and without a partner, counted by class; existence over a group."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    right = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    yes, no = lists.unlinked(orders, right, ["k"])
    both = yes.withColumn("has_line", F.lit(True)).unionByName(no.withColumn("has_line", F.lit(False)))
    return both.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.bool_or("has_line").alias("any_linked"), F.count(F.lit(1)).alias("n"), F.count_if("has_line").alias("linked"), F.count_if(~F.col("has_line")).alias("unlinked"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 1),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 10 <> 2)
SELECT kind, changed_columns, count(*) AS n FROM (
  SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.status <> b.status OR a.price <> b.price THEN 'changed' ELSE 'same' END AS kind,
    CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.status <> b.status THEN 'status' END, CASE WHEN a.price <> b.price THEN 'price' END) END AS changed_columns
  FROM a FULL JOIN b USING (k)) GROUP BY ALL""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added, removed and changed between two derived snapshots of the orders."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    old = orders.where(k % 10 != 1).select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = orders.where(k % 10 != 2).select(k.alias("k"), F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("price"))
    return lists.snapshot_diff(old, new, ["k"], ["status", "price"]).groupBy("kind", "changed_columns").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'new' WHEN o_orderkey % 8 = 0 THEN 'changed' WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'old' END AS reason FROM orders)
WHERE reason IS NOT NULL GROUP BY 1""")
def stale_fact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys an incremental refresh has to recompute, by reason."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    current = orders.select(k, F.concat_ws("|", "o_orderstatus", "o_totalprice").alias("fingerprint"), (F.col("o_orderstatus") == "O").alias("open"))
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    stored = orders.where(k % 9 != 0).select(k, F.when(k % 8 == 0, "outdated").otherwise(F.concat_ws("|", "o_orderstatus", "o_totalprice")).alias("fingerprint"), F.when(k % 5 == 0, now - F.expr("INTERVAL 30 HOURS")).otherwise(now).alias("read_at"))
    return lists.stale_keys(current, stored, ["o_orderkey"], now).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(pos AS INTEGER) AS pos, ministry, has_drafts, n FROM (
  SELECT ministry, has_drafts, n, row_number() OVER (ORDER BY has_drafts DESC, n DESC, ministry) AS pos FROM (
    SELECT n_name AS ministry, count(o_orderkey) > 0 AS has_drafts, count(o_orderkey) AS n
    FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY 1))
WHERE pos <= 20""")
def rank_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies by number of large drafts, those without any last."""
    nation = table(spark, sf_dir, "nation")
    made = table(spark, sf_dir, "orders").where("o_totalprice > 300000").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"))
    df = nation.join(made, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("ministry"), F.coalesce("c", F.lit(0)).alias("n"))
    df = df.withColumn("has_drafts", F.col("n") > 0)
    return lists.page(df, [F.desc("has_drafts"), F.desc("n"), F.col("ministry")], 20).select("pos", "ministry", "has_drafts", "n")


@query("""SELECT n_nationkey AS code, min(n_name) AS name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) = 1998 GROUP BY 1""")
def distinct_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ministries with a draft in a period, with their name: the options of a filter."""
    return drafts(spark, sf_dir).where("gp = 1998").groupBy(F.col("ministry_code").alias("code")).agg(F.min(F.nullif("ministry", F.lit(""))).alias("name"), F.count(F.lit(1)).alias("n"))
