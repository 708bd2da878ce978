"""Aggregations and ordered analytics over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import folds, ordered
from strandline.plans.base import registry, table

QUERIES, SQL, query = registry()


@query("""SELECT user_id, event_id, kind, value FROM (SELECT user_id, event_id, event_type AS kind, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""")
def furthest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of the greatest value per user, the first on ties."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("kind"), "value")
    return folds.furthest_wins(e, ["user_id"], "value", "event_id").select("user_id", "event_id", "kind", "value")


@query("""SELECT user_id, arg_min(CASE WHEN value > 50 THEN value END, CASE WHEN value > 50 THEN event_id END) AS first_big,
  arg_min(CASE WHEN event_type = 'purchase' THEN ts END, CASE WHEN event_type = 'purchase' THEN event_id END) AS first_purchase FROM events GROUP BY 1""")
def first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the first known value of two partly unknown columns."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 50, F.col("value")).alias("first_big"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("first_purchase"))
    return folds.first_known(e, ["user_id"], ["first_big", "first_purchase"], "event_id")


@query("""SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def unique_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user."""
    return folds.unique_by(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("""SELECT o_orderpriority AS priority, count(*) AS total, count_if(o_orderstatus = 'F') AS done, count_if(o_orderstatus = 'O') AS running, count_if(o_orderstatus NOT IN ('F', 'O')) AS rest FROM orders GROUP BY 1""")
def counts_that_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts that add up to the total."""
    df = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority")
    return folds.shares_that_partition(df, ["priority"], {"done": F.col("o_orderstatus") == "F", "running": F.col("o_orderstatus") == "O"})


@query("""SELECT l_returnflag AS flag, CAST(count(*) AS BIGINT) AS n,
  list_sort(list(l_extendedprice))[CAST(least(floor(count(*) * 0.9), count(*) - 1) AS BIGINT) + 1] AS q_floor,
  list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS q_rounded,
  list_sort(list(l_extendedprice))[CAST(greatest(ceil(count(*) * 0.9) - 1, 0) AS BIGINT) + 1] AS q_ceil
FROM lineitem GROUP BY 1""")
def quantile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three quantile rules of a price by flag, exact and without collecting a group."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return folds.ranks_of(df, ["flag"], "l_extendedprice", {"q_floor": folds.floor_rank(0.9), "q_rounded": folds.rounded_rank(0.9), "q_ceil": folds.ceil_rank(0.9)})


@query("""SELECT CAST(greatest(least(floor(days / 365), 4), -4) AS BIGINT) AS bucket, count(*) AS n, avg(CASE WHEN days <= 60 THEN 1.0 ELSE 0.0 END) AS within_60 FROM (
  SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from order to shipping in fixed ranges, and the share within 60 days."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    df = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return df.select(F.greatest(F.least(F.floor(days / 365), F.lit(4)), F.lit(-4)).alias("bucket"), (days <= 60).cast("double").alias("early")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("early").alias("within_60"))


@query("""SELECT l_returnflag AS flag, count_if(l_linestatus = 'F') AS "F", count_if(l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""")
def cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion table of two labels."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT CAST(day AS VARCHAR) AS day, user_id, n FROM (
  WITH c AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS u, count(*) AS n FROM events GROUP BY 1, 2),
  r AS (SELECT day, n, CASE WHEN row_number() OVER (PARTITION BY day ORDER BY n DESC, u) <= 10 THEN u ELSE 'andere' END AS user_id FROM c)
  SELECT day, user_id, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2)""")
def capped_top_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day the ten busiest users, the rest under one name; no event is lost."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("user_id"))
    return folds.capped_counts(e, ["day"], "user_id", 10).withColumn("day", F.col("day").cast("string"))


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series((SELECT min(day) + 1 FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT CAST(s.day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM s LEFT JOIN c ON s.day = c.day""")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases per day over an unbroken run of days, without the first, partial one."""
    c = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return folds.with_spine(c, "day", "n").withColumn("day", F.col("day").cast("string"))


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, grouping(event_type) AS level FROM events GROUP BY ROLLUP (CAST(ts AS DATE), event_type) HAVING CAST(ts AS DATE) IS NOT NULL""")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and class counts with day totals in one pass."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type")
    return e.rollup("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("event_type").cast("long").alias("level")).where("day IS NOT NULL").withColumn("day", F.col("day").cast("string"))


@query("""WITH c AS (SELECT lower(split_part(p_name, ' ', 1)) AS word, p_name AS name, count(*) AS n FROM part GROUP BY 1, 2),
t AS (SELECT word, max(n) AS top, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1)
SELECT min(c.name) AS name, any_value(t.n) AS n FROM c JOIN t ON c.word = t.word AND c.n = t.top GROUP BY t.word""")
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-name groups merged by a normal key, under the largest group's name."""
    c = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return folds.merge_groups(c, "name", "n", F.lower(F.split("name", " ")[0]))


@query("""WITH d AS (SELECT l_partkey AS act, r_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT act, CAST(sum(n) AS BIGINT) AS total, count(*) AS publishers, array_to_string(list_sort(list(r_name)), ',') AS named_in FROM d GROUP BY 1""")
def act_map_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge of drafts and acts: per act the uses and the set of publishers."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    df = lines.join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    return df.groupBy(F.col("l_partkey").alias("act")).agg(F.count(F.lit(1)).alias("total"), F.collect_set("r_name").alias("s")).select("act", "total", F.size("s").cast("long").alias("publishers"), F.array_join(F.array_sort("s"), ",").alias("named_in"))


@query("""SELECT p_partkey AS act, array_to_string(list_sort(list(r_name)), ',') AS missing FROM part CROSS JOIN region
WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_partkey = p_partkey AND n_regionkey = r_regionkey) GROUP BY 1""")
def publishers_without_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per act the publishers (a fixed set of a few) that name it nowhere; acts named everywhere are absent."""
    region = table(spark, sf_dir, "region")
    every = F.array_sort(F.collect_list("r_name"))
    have = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    have = have.groupBy("l_partkey").agg(F.collect_set("r_name").alias("have"))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("act")).join(have, F.col("act") == F.col("l_partkey"), "left").withColumn("every", region.agg(every).scalar())
    missing = F.array_except("every", F.coalesce("have", F.array().cast("array<string>")))
    return df.where(F.size(missing) > 0).select("act", F.array_join(missing, ",").alias("missing"))


@query("""SELECT k, line, price, runner_up FROM (SELECT l_orderkey AS k, l_linenumber AS line, l_extendedprice AS price, row_number() OVER w AS r, lead(l_extendedprice) OVER w AS runner_up FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)) WHERE r = 1""")
def best_and_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line of each order beside the second best."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"))
    return ordered.margin(lines, "k", "price", [F.desc("price"), F.col("line")])


@query("""SELECT user_id, event_id, value, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest events of each user."""
    return ordered.top_per_group(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 5)


@query("""SELECT event_id, user_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def nearest_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event before and after each one of the same user."""
    return ordered.neighbours(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "user_id", "before", "after")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS in_effect FROM events""")
def carried_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the last purchase stays in effect for a user's later events."""
    e = table(spark, sf_dir, "events").withColumn("h", F.when(F.col("event_type") == "purchase", F.col("value")))
    return ordered.carried(e, ["user_id"], ["ts", "event_id"], "h", "in_effect").select("event_id", "in_effect")


@query("""SELECT user_id, island, count(*) AS n, min(event_id) AS first_event FROM (
  SELECT user_id, event_id, CAST(sum(CASE WHEN prev IS NOT NULL AND prev <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY 1, 2""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of one event type in a row, by user."""
    e = ordered.neighbours(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    marked = ordered.islands(e, ["user_id"], ["ts", "event_id"], F.col("before") != F.col("event_type"))
    return marked.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""SELECT user_id, event_id, CAST(spent_before AS BIGINT) AS spent_before FROM (SELECT user_id, event_id, coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before FROM events) WHERE spent_before < 50000""")
def within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events until a budget of value is spent."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("cost"))
    return ordered.within_budget(e, ["user_id"], ["event_id"], "cost", 50000).select("user_id", "event_id", "spent_before")


@query("""WITH s AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS starts FROM orders)
SELECT CAST(starts AS VARCHAR) AS starts, CAST(CAST(lead(starts) OVER (ORDER BY starts) - 1 AS DATE) AS VARCHAR) AS ends FROM s""")
def period_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods from their starts: each ends the day before the next."""
    s = table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("starts")).distinct()
    return ordered.period_ends(s, "starts").select(F.col("starts").cast("string").alias("starts"), F.col("ends").cast("string").alias("ends"))


@query("""SELECT conv_id, CAST(line AS INTEGER) AS line, turn, side FROM (
  SELECT conv_id, turn, side, row_number() OVER (PARTITION BY conv_id ORDER BY seen NULLS FIRST, side, turn) AS line FROM (
    SELECT conv_id, turn, side, last_value(day IGNORE NULLS) OVER (PARTITION BY conv_id, side ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seen FROM (
      SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS side, CASE WHEN turn % 3 <> 2 THEN turn // 2 END AS day FROM conversations)))""")
def merged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides of a conversation as one timeline; undated turns take the date before them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 3 != 2, F.floor(F.col("turn") / 2)).alias("day"))
    both = ordered.merged_timeline(c.where("role = 'user'").drop("role"), c.where("role <> 'user'").drop("role"), ["conv_id"], "day", "turn")
    return both.select("conv_id", "line", "turn", "side")


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, avg(value) AS mean_value, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS users FROM events GROUP BY CAST(ts AS DATE), event_type""")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and class tallies of the events."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.avg("value").alias("mean_value"), F.min("value").alias("least"), F.max("value").alias("most"), F.countDistinct("user_id").alias("users"))


@query("""SELECT CASE WHEN judged < 3 THEN 'unchecked' WHEN passed * 10 < judged * 7 THEN 'doubtful' ELSE 'verified' END AS verdict, count(*) AS laws, CAST(sum(judged) AS BIGINT) AS judged FROM (
  SELECT l_orderkey, count_if(l_returnflag <> 'N') AS judged, count_if(l_returnflag = 'A') AS passed FROM lineitem GROUP BY 1) GROUP BY 1""")
def cluster_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict per group: unchecked, doubtful under 70 % passed, or verified."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "N").alias("judged"), F.count_if(F.col("l_returnflag") == "A").alias("passed"))
    verdict = F.when(F.col("judged") < 3, "unchecked").when(F.col("passed") * 10 < F.col("judged") * 7, "doubtful").otherwise("verified")
    return g.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("laws"), F.sum("judged").alias("judged"))


@query("""SELECT o_orderpriority AS priority, try_div(CAST(changed AS DOUBLE), total) AS share FROM (SELECT o_orderpriority, count_if(o_orderstatus = 'F' AND o_totalprice > 400000) AS changed, count_if(o_totalprice > 400000) AS total FROM orders GROUP BY 1)""".replace("try_div(CAST(changed AS DOUBLE), total)", "CASE WHEN total > 0 THEN CAST(changed AS DOUBLE) / total END"))
def share_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share that is null, not zero, for an empty whole."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)).alias("c"), F.count_if(F.col("o_totalprice") > 400000).alias("t"))
    return g.select("priority", F.try_divide(F.col("c").cast("double"), F.col("t")).alias("share"))


@query("""SELECT 'Rechtswissenschaftliche Fakultät ' || p_size AS name, count(*) AS n FROM part GROUP BY p_size""")
def merged_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names one typed letter apart in a long word are one body; names that differ in a digit are not."""
    typed = F.when(F.col("p_partkey") % 40 == 3, "Rechtswisssenschaftliche").when(F.col("p_partkey") % 40 == 7, "Rechtswissenschaftlicke").when(F.col("p_partkey") % 40 == 9, "RECHTSWISSENSCHAFTLICHE").otherwise("Rechtswissenschaftliche")
    names = table(spark, sf_dir, "part").select(F.concat(typed, F.lit(" Fakultät "), F.col("p_size").cast("string")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    merged = folds.merge_near_groups(names, "name", "n")
    # The lead of a size that only slips were drawn for is a slip: the number says which body it is.
    return merged.groupBy(F.concat(F.lit("Rechtswissenschaftliche Fakultät "), F.regexp_extract("name", r"(\d+)$", 1)).alias("name")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).where(F.assert_true(F.col("rows") == 1, F.lit("a body stands twice")).isNull()).drop("rows")


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN user_id % 9 = 0 THEN 'andere' ELSE 'h' || user_id END AS host, count(*) AS n FROM events GROUP BY 1, 2),
t AS (SELECT host, sum(n) AS n FROM c WHERE day > (SELECT min(day) FROM c) AND host <> 'andere' GROUP BY 1 HAVING sum(n) >= 5)
SELECT host, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM (SELECT host, n, row_number() OVER (ORDER BY n DESC, host) AS rank FROM t) WHERE rank <= 20""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty hosts that sent most readers, from five on, without the first stored day and the bucket of others."""
    host = F.when(F.col("user_id") % 9 == 0, "andere").otherwise(F.concat(F.lit("h"), F.col("user_id").cast("string")))
    c = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), host.alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return folds.usage_summary(c, "day", "host", "n", "andere", 5, 20)
