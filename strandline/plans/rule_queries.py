"""Filters, rules, list cuts and served documents over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import citations, dates, similarity, text
from strandline.operators import lists, ordered
from strandline.plans.base import DRAFTS_SQL, drafts, registry, table

QUERIES, SQL, query = registry()
DAY = "1998-06-01"


@query(f"""WITH {DRAFTS_SQL} SELECT inr FROM d WHERE status IN ('O', 'P') AND gp BETWEEN 1995 AND 1998 AND ministry_code IN (3, 7, 21) AND contains(lower(title), '7') AND NOT (priority LIKE '5%')""")
def filter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records filtered by kind, period, body and text together; all of it reaches the scans."""
    d = drafts(spark, sf_dir)
    return d.where(F.col("status").isin("O", "P") & F.col("gp").between(1995, 1998) & F.col("ministry_code").isin(3, 7, 21) & text.matches_all(F.col("title"), "7") & ~F.col("priority").startswith("5")).select("inr")


@query("""SELECT p_partkey AS id, p_partkey % 3 = 0 AS within, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS found FROM part""")
def search_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches beyond the caps on characters or words find nothing, whatever they would match."""
    p = table(spark, sf_dir, "part")
    asked = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.repeat("p_name", 200)).otherwise(F.repeat(F.concat(F.lit("w "), F.substring("p_name", 1, 2), F.lit(" ")), 60))
    within = citations.within_caps(asked)
    return p.select(F.col("p_partkey").alias("id"), within.alias("within"), F.when(within & F.contains(F.col("p_name"), asked), 1).otherwise(0).alias("found"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'verordnung' WHEN p_partkey % 4 = 1 THEN 'gesetz' ELSE 'other' END AS class, p_partkey % 4 = 1 AND p_size > 25 AS budget,
  CASE WHEN p_partkey % 4 = 1 AND p_size > 25 THEN 'budget' END AS exempt FROM part""")
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles classed by their words, and exempt ones by a small table of exemptions."""
    kind = F.col("p_partkey") % 4
    title = F.concat(F.when(kind == 0, F.lit("Verordnung zum Gesetz über ")).when((kind == 1) & (F.col("p_size") > 25), F.lit("Bundesfinanzgesetz über ")).when(kind == 1, F.lit("Gesetz über ")).otherwise(""), "p_name")
    rules = spark.createDataFrame([("(?i)bundesfinanzgesetz|budgetbegleitgesetz", "budget")], "pattern string, exempt string")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title.alias("title"), citations.record_class(title).alias("class"))
    # Three rows at most: a table of patterns is no equality join.
    return p.join(F.broadcast(rules), F.regexp_like("title", F.col("pattern")), "left").select("id", "class", F.col("exempt").isNotNull().alias("budget"), "exempt")


@query(f"""WITH {DRAFTS_SQL} SELECT inr, CASE priority WHEN '1-URGENT' THEN 'bill' ELSE 'motion' END AS kind FROM d WHERE CAST(inr % 6 AS VARCHAR) IN ('1', '2', '3', '4') AND priority IN ('1-URGENT', '2-HIGH')""")
def second_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the second round: a status that is still running and a known document type, which names the kind."""
    kinds = F.create_map(F.lit("1-URGENT"), F.lit("bill"), F.lit("2-HIGH"), F.lit("motion"))
    d = drafts(spark, sf_dir).where((F.col("inr") % 6).cast("string").isin("1", "2", "3", "4"))
    return d.select("inr", F.try_element_at(kinds, F.col("priority")).alias("kind")).where("kind IS NOT NULL")


_MATRIX = [("all", "1-URGENT"), ("all", "2-HIGH"), ("all", "3-MEDIUM"), ("all", "4-NOT SPECIFIED"), ("all", "5-LOW"), ("laws", "1-URGENT"), ("laws", "2-HIGH"), ("ordinances", "3-MEDIUM"), ("others", "5-LOW"), ("others", "4-NOT SPECIFIED")]


@query(f"""SELECT option, count(*) AS n, sum(o_orderkey) AS keys FROM orders JOIN (VALUES {', '.join(map(str, _MATRIX))}) m(option, kind) ON o_orderpriority = kind GROUP BY 1""")
def admitted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each option of a list admits, by its matrix of kinds."""
    matrix = spark.createDataFrame(_MATRIX, "option string, kind string")
    return lists.admitted(table(spark, sf_dir, "orders"), matrix, "o_orderpriority").groupBy("option").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("long").alias("keys"))


@query("""SELECT o_orderkey AS id, n_name AS country FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderpriority LIKE '2%' AND o_orderstatus = 'O' AND n_name IN ('FRANCE', 'GERMANY', 'NATION_3', 'NATION_7') AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01'""")
def filter_petitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half's lists: kind, still open, country and span together."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("2") & (F.col("o_orderstatus") == "O") & dates.in_window(F.to_date("o_orderdate"), F.lit("1996-01-01").cast("date"), F.lit(None).cast("date")))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).where(F.col("n_name").isin("FRANCE", "GERMANY", "NATION_3", "NATION_7")).select(F.col("o_orderkey").alias("id"), F.col("n_name").alias("country"))


@query("""SELECT o_orderkey AS id, CAST(year(o_orderdate) AS VARCHAR) AS gp, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'all' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'rv|bgbl' ELSE '' END AS stations, o_orderpriority AS q FROM orders""")
def parsed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests' query strings as parameters: known values only, a list deduplicated in its order, what is unknown falls back to the default."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("bogus")
    stations = F.when(F.col("o_orderkey") % 2 == 0, F.lit("rv,bgbl,rv,other")).otherwise("none")
    url = F.concat(F.lit("https://x.example/list?gp="), F.year("o_orderdate").cast("string"), F.lit("&status="), status, F.lit("&station="), stations, F.lit("&q="), F.url_encode("o_orderpriority"))
    part = lambda name: F.try_parse_url(F.col("url"), F.lit("QUERY"), F.lit(name))
    known = F.filter(F.array_distinct(F.split(part("station"), ",")), lambda s: s.isin("begutachtung", "rv", "parlament", "bgbl"))
    asked = o.select(F.col("o_orderkey").alias("id"), url.alias("url"))
    return asked.select("id", part("gp").alias("gp"), F.when(part("status").isin("open", "closed"), part("status")).otherwise("all").alias("status"), F.array_join(known, "|").alias("stations"), F.url_decode(part("q")).alias("q"))


@query("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'BGBl. I Nr.' ELSE 'BGBl. Nr.' END AS a, CASE o_orderstatus WHEN 'F' THEN 'BGBl. Nr.' WHEN 'O' THEN 'BGBl. I' ELSE 'BGBl. II Nr.' END AS b, 1990 + CAST(o_orderkey % 12 AS INTEGER) AS y FROM orders)
SELECT id, (id % 2 = 0 AND b = 'BGBl. I') OR (id % 2 = 1 AND b = 'BGBl. Nr.') AS exact,
  (id % 2 = 0) = (y >= 1997 AND b <> 'BGBl. II Nr.') AND (y < 1997 OR b <> 'BGBl. II Nr.') AS stored,
  id % 2 = 1 OR b <> 'BGBl. II Nr.' AS cited FROM c""")
def same_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality of citations under three rules: exact, against a stored one (the part follows from the year), and between two texts."""
    k = F.col("o_orderkey")
    a = F.when(k % 2 == 0, "BGBl. I Nr.").otherwise("BGBl. Nr.")
    b = F.when(F.col("o_orderstatus") == "F", "BGBl. Nr.").when(F.col("o_orderstatus") == "O", "BGBl. I").otherwise("BGBl. II Nr.")
    number = F.concat(k.cast("string"), F.lit("/"), (1990 + k % 12).cast("string"))
    rule = lambda f: f(a, number, b, number)
    return table(spark, sf_dir, "orders").select(k.alias("id"), rule(citations.same_exact).alias("exact"), rule(citations.same_stored).alias("stored"), rule(citations.same_cited).alias("cited"))


@query("""WITH i AS (SELECT o_orderkey AS id, 'COM(' || year(o_orderdate) || ')' || o_custkey AS ref FROM orders), p AS (SELECT c_custkey AS pub, 'COM(' || (1992 + c_custkey % 7) || ')' || c_custkey AS carried FROM customer)
SELECT id, pub FROM i JOIN p ON ref = carried""")
def carried_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications that carry exactly the number an initiative has: never a longer number that begins with it."""
    i = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("COM("), F.year("o_orderdate").cast("string"), F.lit(")"), F.col("o_custkey").cast("string")).alias("ref"))
    spaced = F.concat(F.lit("COM ("), (1992 + F.col("c_custkey") % 7).cast("string"), F.lit(") "), F.col("c_custkey").cast("string"), F.lit(" final"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pub"), F.regexp_replace(F.regexp_replace(spaced, r"\s+final$", ""), r"\s", "").alias("ref"))
    return i.join(p, "ref").select("id", "pub")


@query("""WITH f AS (SELECT o_orderkey % 20 AS initiative, o_orderkey % 5 = 0 AS named, o_orderkey % 7 <> 0 AS published, o_orderpriority AS type, n_name AS country FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT initiative, count_if(named) AS contributions, count_if(NOT named AND NOT published) AS unpublished, count_if(NOT named AND published AND type = '1-URGENT') AS citizens, count_if(NOT named AND published AND type = '5-LOW') AS other,
  count_if(NOT named AND published AND type NOT IN ('1-URGENT', '5-LOW')) AS unnamed, count(*) AS total, count(DISTINCT CASE WHEN NOT named AND published AND type = '1-URGENT' THEN country END) AS countries FROM f GROUP BY 1""")
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback in figures: each row counts in exactly one of them, and they sum to the total."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    figure = F.when(F.col("o_orderkey") % 5 == 0, "contributions").when(F.col("o_orderkey") % 7 == 0, "unpublished").when(F.col("o_orderpriority") == "1-URGENT", "citizens").when(F.col("o_orderpriority") == "5-LOW", "other").otherwise("unnamed")
    rows = o.select((F.col("o_orderkey") % 20).alias("initiative"), figure.alias("figure"), F.col("n_name").alias("country"))
    figures = ["contributions", "unpublished", "citizens", "other", "unnamed"]
    counted = rows.groupBy("initiative").agg(*[F.count_if(F.col("figure") == f).alias(f) for f in figures], F.count(F.lit(1)).alias("total"), F.count_distinct(F.when(F.col("figure") == "citizens", F.col("country"))).alias("countries"))
    parts = F.col(figures[0]) + F.col(figures[1]) + F.col(figures[2]) + F.col(figures[3]) + F.col(figures[4])
    return counted.withColumn("total", F.when(F.assert_true(parts == F.col("total"), F.lit("a row counts twice or never")).isNull(), F.col("total")))


@query("""WITH u AS (SELECT l_orderkey AS doc, l_linenumber AS unit, l_returnflag <> 'R' AS shown FROM lineitem)
SELECT doc, count(*) AS touched, count_if(shown) AS shown, count_if(NOT shown) AS withheld, count(*) = count(DISTINCT unit) AS balanced FROM u GROUP BY 1""")
def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown and withheld units make the touched ones, and no unit is among them twice."""
    u = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("unit"), (F.col("l_returnflag") != "R").alias("shown"))
    per_unit = u.groupBy("doc", "unit").agg(F.count(F.lit(1)).alias("n"), F.count_if("shown").alias("shown"))
    return per_unit.groupBy("doc").agg(F.sum("n").alias("touched"), F.sum("shown").alias("shown"), F.sum(F.col("n") - F.col("shown")).alias("withheld"), (F.max("n") == 1).alias("balanced"))


@query("""WITH b AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders), a AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_totalprice * (1 + o_orderkey % 3) DESC, o_orderkey) AS pos FROM orders)
SELECT greatest(50, coalesce(max(a.pos), 0)) AS cut FROM a JOIN b USING (k) WHERE b.pos <= 50""")
def kept_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to cut a list that was ordered anew, so that the fifty rows shown before stay shown."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    shown = lists.page(o, [F.desc("o_totalprice"), F.col("k")], 50)
    again = o.withColumn("score", F.col("o_totalprice") * (1 + F.col("k") % 3))
    return lists.kept_cut(shown, again, "k", F.struct("score", -F.col("k")), 50)


@query("""SELECT user_id, event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS moving,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS near FROM events""")
def moving_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by rows (a moving average of five) and by time (requests of the last six hours)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    rows = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    span = Window.partitionBy("user_id").orderBy("at").rangeBetween(-6 * 3600 * 1_000_000, 0)
    return e.select("user_id", "event_id", F.avg("value").over(rows).alias("moving"), F.count(F.lit(1)).over(span).alias("near"))


@query("""SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_custkey % 3, o_orderkey % 997, CASE WHEN o_orderstatus = 'F' THEN '' ELSE lower(o_orderstatus) END, o_orderkey) AS pos FROM orders""")
def designation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units in the order a law prints them: articles, paragraphs, annexes, each by number and then letter."""
    letter = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.lower("o_orderstatus"))
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("kind"), F.concat((F.col("o_orderkey") % 997).cast("string"), letter).alias("designation"))
    return ordered.positions(units, [F.col("kind"), *text.natural_order(F.col("designation")), F.col("id")]).select("id", "pos")


@query("""SELECT sort, id, CAST(pos AS INTEGER) AS pos FROM (
  SELECT 'newest' AS sort, s_suppkey AS id, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 30 END DESC NULLS LAST, s_suppkey) AS pos FROM supplier UNION ALL
  SELECT 'name', s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN s_name END ASC NULLS LAST, s_suppkey) FROM supplier UNION ALL
  SELECT 'support', s_suppkey, row_number() OVER (ORDER BY s_suppkey % 11 DESC, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 30 END DESC NULLS LAST, s_suppkey) FROM supplier) WHERE pos <= 25""")
def list_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list under its three orders: newest, by name with the unnamed last, by support and then newest."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 30).alias("day"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("name"), (F.col("s_suppkey") % 11).alias("support"))
    newest = F.col("day").desc_nulls_last()
    orders = {"newest": [newest, F.col("id")], "name": [F.col("name").asc_nulls_last(), F.col("id")], "support": [F.desc("support"), newest, F.col("id")]}
    out = [lists.page(s, order, 25).select(F.lit(sort).alias("sort"), "id", "pos") for sort, order in orders.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH {DRAFTS_SQL} SELECT inr, CASE WHEN row_number() OVER (ORDER BY arrived, inr) <= 500 THEN 'read' ELSE 'skipped' END AS state FROM d""")
def allotted_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hundred units are read, the others named as skipped."""
    return lists.allotted(drafts(spark, sf_dir).select("inr", "arrived"), "inr", [F.col("arrived"), F.col("inr")], 500).select("inr", "state")


@query("""SELECT source, state, n FROM (VALUES ('orders', 'read', (SELECT count(*) FROM orders)), ('supplier', 'read', (SELECT count(*) FROM supplier)), ('broken', 'failed', 0), ('missing', 'failed', 0)) t(source, state, n)""")
def tolerant_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that each settle alone: one is absent, one fails while it is read; both are reported and the others count."""
    sources = {
        "orders": lambda: table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "supplier": lambda: table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")),
        "broken": lambda: table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).where(F.assert_true(F.col("id") < 3, F.lit("shape changed")).isNull()), "missing": lambda: table(spark, sf_dir, "no_such_table"),
    }
    rows, states = lists.tolerant_union(sources)
    status = spark.createDataFrame(states, "source string, state string, reason string")
    return status.join(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left").select("source", "state", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH p AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part)
SELECT id, len(list_filter(a, lambda w: NOT list_contains(b, w))) AS extra, len(list_filter(list_distinct(a), lambda w: len(list_filter(a, lambda x: x = w)) > len(list_filter(b, lambda x: x = w)))) = 0 AS bag_subset, len(list_filter(a, lambda w: list_contains(b, w))) / len(a) AS covered FROM p""")
def subset_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a name's words are a bag within its type's, which are extra, and the share that is covered."""
    words = lambda c: F.split(F.lower(c), " ")
    a, b = F.col("a"), F.col("b")
    fits = F.forall(F.array_distinct(a), lambda w: F.size(F.filter(a, lambda x: x == w)) <= F.size(F.filter(b, lambda x: x == w)))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), words("p_name").alias("a"), words("p_type").alias("b"))
    return p.select("id", F.size(F.filter(a, lambda w: ~F.array_contains(b, w))).cast("long").alias("extra"), fits.alias("bag_subset"), similarity.coverage(a, b).alias("covered"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN list_transform(range(o_orderkey % 9 + 1, o_orderkey % 9 + 4), lambda i: CAST(i AS VARCHAR)) WHEN 1 THEN ['7a', '7b', '7c'] WHEN 2 THEN ['3', '9', '12'] ELSE ['9 bis 4'] END AS units FROM orders""")
def expanded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of designations as lists: of numbers, of letters, listed ones; a span that runs backwards stays as it is."""
    k = F.col("o_orderkey")
    span = F.when(k % 4 == 0, F.concat((k % 9 + 1).cast("string"), F.lit(" bis "), (k % 9 + 3).cast("string"))).when(k % 4 == 1, "7a bis 7c").when(k % 4 == 2, "3, 9 und 12").otherwise("9 bis 4")
    return table(spark, sf_dir, "orders").select(k.alias("id"), citations.expanded(span).alias("units"))


@query("""SELECT p_partkey AS id, p_brand AS short, '1.234.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS grouped, CASE WHEN p_size = 1 THEN '1 unit' ELSE p_size || ' units' END AS label,
  CASE WHEN p_size < 50 AND CAST(floor(100 * p_size / 50 + 0.5) AS BIGINT) = 100 THEN 99 ELSE CAST(floor(100 * p_size / 50 + 0.5) AS BIGINT) END AS percent, round(100.0 * (p_size - 1) / 49, 1) AS place, '5. 1. 2024' AS day FROM part""")
def labels_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short titles, grouped numbers, counted labels, percents and places between two ends, and a day's label."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("long")
    return p.select(
        F.col("p_partkey").alias("id"), citations.short_title(F.concat("p_brand", F.lit(" 2024, Änderung und mehr"))).alias("short"), citations.grouped_number(1234000 + F.col("p_partkey") % 1000).alias("grouped"), citations.counted_label(size, "unit", "units").alias("label"),
        citations.percent_of(size, F.lit(50)).alias("percent"), citations.percent_position(size.cast("double"), F.lit(1.0), F.lit(50.0)).alias("place"), citations.day_label(F.lit("2024-01-05").cast("date")).alias("day"),
    )


@query(f"""WITH {DRAFTS_SQL} SELECT inr, CASE WHEN deadline IS NULL THEN 'unknown' WHEN deadline - arrived < 21 THEN 'short' WHEN deadline - arrived < 42 THEN 'shortened' ELSE 'full' END AS class,
  CASE WHEN deadline IS NULL THEN NULL WHEN inr % 3 = 0 THEN 'earlier' WHEN inr % 3 = 1 THEN 'same' ELSE 'later' END AS divergence FROM d""")
def deadline_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines classed by their length, and whether a second source names another day."""
    d = drafts(spark, sf_dir).withColumn("other", F.date_add("deadline", (F.col("inr") % 3 - 1).cast("int")))
    return d.select("inr", dates.deadline_class(F.col("arrived"), F.col("deadline")).alias("class"), dates.divergence(F.col("deadline"), F.col("other")).alias("divergence"))


@query("""SELECT event_id, CASE WHEN ts < TIMESTAMP '1900-01-01' THEN NULL ELSE CAST(CAST(timezone('Europe/Vienna', timezone('UTC', ts)) AS DATE) AS VARCHAR) END AS day FROM events""")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The civil day in Vienna of each request."""
    return table(spark, sf_dir, "events").select("event_id", dates.local_day(F.col("ts").cast("timestamp")).cast("string").alias("day"))


@query("""SELECT p_partkey AS id, p_name || ' ü' AS good, p_name || ' ü' AS legacy FROM part""")
def decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in two encodings as text: UTF-8 where it is valid, else the declared one."""
    name = F.concat("p_name", F.lit(" ü"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.decoded(F.encode(name, "UTF-8"), "ISO-8859-1").alias("good"), text.decoded(F.encode(name, "ISO-8859-1"), "ISO-8859-1").alias("legacy"))


@query(f"""WITH {DRAFTS_SQL} SELECT gp, count(*) AS total, '{{"gp":' || gp || ',"total":' || count(*) || ',"open":' || count_if(status = 'O') || ',"complete":true}}' AS document FROM d GROUP BY 1""")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON document of each period's list: total, open ones and the availability flag."""
    per = drafts(spark, sf_dir).groupBy("gp").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "O").alias("open"))
    return per.select("gp", "total", F.to_json(F.struct("gp", "total", "open", F.lit(True).alias("complete"))).alias("document"))


@query("""SELECT user_id, event_id, CASE WHEN age <= 1800 THEN 'fresh' WHEN age <= 12600 THEN CASE WHEN event_id % 5 = 0 THEN 'stale' ELSE 'revalidate' END WHEN age IS NULL THEN CASE WHEN event_id % 5 = 0 THEN 'pending' ELSE 'absent' END ELSE CASE WHEN event_id % 5 = 0 THEN 'pending' ELSE 'expired' END END AS state
  FROM (SELECT user_id, event_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS age FROM events)""")
def cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache answers to each request: fresh, stale while it is read again, pending on a read that runs, expired or absent."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "ts")
    age = F.col("at") - F.lag("at").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", "event_id", lists.cache_state(age, 1800, 10800, F.col("event_id") % 5 == 0).alias("state"))


@query("""WITH u AS (SELECT user_id AS k, max(ts) AS used, CAST(count(*) * 1000 AS BIGINT) AS size FROM events GROUP BY 1), r AS (SELECT *, sum(size) OVER (ORDER BY used DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM u)
SELECT k, CAST(upto AS BIGINT) AS upto FROM r WHERE upto <= 200000""")
def within_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that a cache with a budget of bytes keeps, least recently used ones gone."""
    u = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("ts").alias("used"), (F.count(F.lit(1)) * 1000).alias("size"))
    return lists.within_bytes(u.withColumn("used", F.col("used").cast("timestamp")), "used", "size", 200_000, "k").select("k", "upto")


@query("""WITH t AS (SELECT user_id AS k, ts, event_id, value < 40 AS failed FROM events), l AS (SELECT k, max(CASE WHEN NOT failed THEN (ts, event_id) END) AS ok FROM t GROUP BY 1), f AS (SELECT t.k, count(*) AS failures FROM t JOIN l USING (k) WHERE failed AND (ok IS NULL OR (t.ts, t.event_id) > ok) GROUP BY 1)
SELECT k, failures, CASE WHEN failures < 5 THEN CAST(60 * 2 ** (failures - 1) AS BIGINT) END AS wait_seconds, failures >= 5 AS given_up FROM f""")
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When to read each failing source again: doubling waits since its last success, given up after five."""
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.struct("ts", "event_id").alias("at"), (F.col("value") < 40).alias("failed"))
    return lists.retry_plan(t, "k", "failed", "at").select("k", "failures", "wait_seconds", "given_up")


@query("""SELECT k, reads, asked FROM (SELECT user_id AS k, count(DISTINCT CAST(epoch_us(ts) // 3600000000 AS BIGINT)) AS reads, count(*) AS asked FROM events GROUP BY 1)""")
def pending_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of one key that come within an hour share one read: how many are made of how many asked for."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour"))
    return e.groupBy("k", "hour").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.count(F.lit(1)).alias("reads"), F.sum("n").alias("asked"))


@query("""WITH q AS (SELECT 1 AS one), w AS (SELECT doc_id, lower(text) AS low, source FROM documents), m AS (SELECT doc_id, CASE WHEN regexp_matches(low, '(^|[^\\p{L}\\p{N}])the([^\\p{L}\\p{N}]|$)') AND regexp_matches(low, '(^|[^\\p{L}\\p{N}])th[\\p{L}\\p{N}]*([^\\p{L}\\p{N}]|$)') THEN 0
  WHEN contains(low, 'the') AND contains(low, 'th') THEN 1 ELSE 2 END AS class FROM w)
SELECT class, doc_id, CAST(pos AS INTEGER) AS pos FROM (SELECT class, doc_id, row_number() OVER (ORDER BY class, doc_id) AS pos FROM m WHERE class < 2) WHERE pos <= 60""")
def evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search parsed into terms and answered in classes: whole words (or word beginnings, with a star) before loose hits, input order inside."""
    terms = spark.range(1).select(citations.search_terms(F.lit('  „the"  TH* t the ')).alias("t")).first()["t"]
    low = F.lower("text")
    edge = r"[\p{L}\p{N}]"
    strict, loose = F.lit(True), F.lit(True)
    for term in terms:
        word = "".join(c if c.isalnum() else "\\" + c for c in term["text"])
        strict = strict & low.rlike(f"(?<!{edge}){word}{edge + '*' if term['prefix'] else ''}(?!{edge})")
        loose = loose & F.contains(low, F.lit(term["text"]))
    found = table(spark, sf_dir, "documents").select("doc_id", F.when(strict, 0).when(loose, 1).otherwise(2).alias("class")).where("class < 2")
    return lists.page(found, [F.col("class"), F.col("doc_id")], 60).select("class", "doc_id", "pos")
