"""Document comparison, amendments, scans, sinks and usage over the test tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import amend, diffs, ordered, privacy
from strandline.plans.base import DRAFTS_SQL, drafts, registry, table
from strandline.sources import pages, scans, sinks
from strandline.streaming import usage

QUERIES, SQL, query = registry()


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive versions of a text: the turns of a conversation by role, each with the one before."""
    return ordered.neighbours(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"], "text").where("before IS NOT NULL").select("conv_id", "turn", F.col("before").alias("old"), F.col("text").alias("new"))


@query()
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word difference of successive versions: similarity, words equal, removed, inserted, and the class of the change."""
    d = _versions(spark, sf_dir).withColumn("diff", diffs.word_diffs(F.col("old"), F.col("new")))
    return d.select("conv_id", "turn", F.round("diff.similarity", 6).alias("similarity"), diffs.counts_of(F.col("diff.segments")).alias("c"), diffs.change_class(F.col("diff")).alias("class")).select("conv_id", "turn", "similarity", "c.*", "class")


@query("""WITH v AS (SELECT conv_id, turn, text AS new, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS old FROM conversations),
a AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(old, '\\s+'), lambda x: x <> '')) AS w FROM v WHERE old IS NOT NULL) GROUP BY ALL),
b AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(new, '\\s+'), lambda x: x <> '')) AS w FROM v WHERE old IS NOT NULL) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS shared FROM a JOIN b USING (conv_id, turn, w) GROUP BY ALL),
t AS (SELECT conv_id, turn, sum(n) AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT conv_id, turn, round(2 * coalesce(shared, 0) / total, 6) AS similarity FROM t LEFT JOIN s USING (conv_id, turn)""")
def bag_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset similarity of successive versions, by exploded words and least counts."""
    v = _versions(spark, sf_dir)
    words = lambda c: v.select("conv_id", "turn", F.explode(text.tokens(F.col(c))).alias("w")).groupBy("conv_id", "turn", "w").agg(F.count(F.lit(1)).alias("n"))
    a, b = words("old"), words("new")
    shared = a.join(b.withColumnRenamed("n", "m"), ["conv_id", "turn", "w"]).groupBy("conv_id", "turn").agg(F.sum(F.least("n", "m")).alias("shared"))
    total = a.unionByName(b).groupBy("conv_id", "turn").agg(F.sum("n").alias("total"))
    return total.join(shared, ["conv_id", "turn"], "left").select("conv_id", "turn", F.round(2 * F.coalesce("shared", F.lit(0)) / F.col("total"), 6).alias("similarity"))


@query()
def unit_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each turn aligned with those of the conversation's turn before, as units of two versions."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"(?<=[.?!]) ")).alias("pos", "text"))
    units = c.select("conv_id", "turn", "pos", F.nullif(F.regexp_extract("text", r"^(\w+):", 1), F.lit("")).alias("heading"), F.col("pos").cast("string").alias("id"), "text")
    turns = ordered.neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct(), ["conv_id"], ["turn"], "turn").where("before IS NOT NULL").select("conv_id", "turn", "before")
    old = units.withColumnRenamed("turn", "before").join(turns, ["conv_id", "before"]).drop("before")
    found = diffs.aligned_units(old, units.join(turns, ["conv_id", "turn"]).drop("before"), ["conv_id", "turn"])
    return found.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("unchanged", "changed", "inserted", "removed")])


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN l.quality IS NULL THEN 'unread' WHEN regexp_replace(lower(d.text), '[^a-z]', '', 'g') = regexp_replace(lower(e.text), '[^a-z]', '', 'g') THEN CASE WHEN d.text = e.text THEN 'unchanged' ELSE 'editorial' END ELSE 'changed' END AS kind
  FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY 1""")
def row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring texts classed by compare keys; a row whose side table was never read is its own class."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    read = table(spark, sf_dir, "labels").select("doc_id", "quality")
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    kind = F.when(F.col("quality").isNull(), "unread").when(key("text") == key("next"), F.when(F.col("text") == F.col("next"), "unchanged").otherwise("editorial")).otherwise("changed")
    return d.join(e, "doc_id").join(read, "doc_id", "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE n - CAST(n >= 2 AS INTEGER) - CAST(n >= 99 AS INTEGER) + 1 END AS rows_after, CAST(CASE WHEN n = 0 THEN 6 ELSE CAST(n < 2 AS INTEGER) + CAST(n < 99 AS INTEGER) + CAST(n < 3 AS INTEGER) + 1 END AS BIGINT) AS refused FROM n""")
def amended_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions applied to the line trees of all documents: applied rows and refusals per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    trees = d.select("doc_id", (F.col("i") + 1).cast("string").alias("path"), "text")
    lines = ["Delete 2.", 'In 1 replace the text by "New wording".', 'After 1 insert 1a: "Inserted".', "Delete 99.", "Renumber 3 as 2.", "do something else"]
    todo = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(*map(F.lit, lines))).alias("pos", "line"))
    found = amend.apply_instructions(trees, todo, "doc_id")
    return found.groupBy("doc_id").agg(F.count_if(F.col("state") == "applied").alias("rows_after"), F.count_if(F.col("state") == "refused").alias("refused"))


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'withheld: refused' WHEN abs(l_quantity - 25) > 20 THEN 'withheld: implausible' WHEN l_linestatus = 'F' THEN 'show' WHEN l_linenumber % 2 = 0 THEN 'withheld: no source' ELSE 'withheld: contradicted' END AS verdict FROM lineitem) GROUP BY 1""")
def gate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results shown or withheld by the first cause that holds; the counts make the whole."""
    second = F.when(F.col("l_linestatus") == "F", "confirmed").when(F.col("l_linenumber") % 2 == 0, F.lit(None)).otherwise("contradicted")
    verdict = amend.gate(F.col("l_returnflag") == "R", amend.plausible(F.lit(25), F.col("l_quantity"), F.lit(0), F.lit(0), 20), second)
    return table(spark, sf_dir, "lineitem").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT text FROM documents WHERE length(text) > 20) SELECT fault, count(*) AS tried, CAST(CASE fault WHEN 'word dropped' THEN count_if(regexp_matches(text, '^\\S+\\s+')) WHEN 'word doubled' THEN count_if(regexp_matches(text, '^\\S')) ELSE 0 END AS BIGINT) AS caught
FROM d, (VALUES ('word dropped'), ('word doubled'), ('blank added'), ('none')) f(fault) GROUP BY 1""")
def fault_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults put into confirmed rows and the share the check catches, per kind of fault."""
    good = table(spark, sf_dir, "documents").where(F.length("text") > 20).select("doc_id", "text")
    kinds = F.explode(F.array(*map(F.lit, ["word dropped", "word doubled", "blank added", "none"])))
    bad = F.when(F.col("fault") == "word dropped", F.regexp_replace("text", r"^\S+\s+", "")).when(F.col("fault") == "word doubled", F.regexp_replace("text", r"^(\S+)", "$1 $1")).when(F.col("fault") == "blank added", F.concat(F.lit("  "), "text")).otherwise(F.col("text"))
    tried = good.withColumn("fault", kinds).withColumn("caught", amend.oracle(bad, F.col("text")) != "confirmed")
    return tried.groupBy("fault").agg(F.count(F.lit(1)).alias("tried"), F.count_if("caught").alias("caught"))


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs, items and cells of every page, counted, with the first heading carried to the page."""
    b = table(spark, sf_dir, "pages").select("page_id", F.explode(scans.html_blocks(F.col("html"))).alias("b")).select("page_id", "b.*")
    return b.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("kind") == "paragraph").alias("paragraphs"), F.min_by("text", F.when(F.col("kind") == "heading", F.col("pos"))).alias("heading"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'nonpublic' WHEN s_suppkey % 3 = 0 THEN 'organisation' ELSE 'person' END AS submitter_class, CASE WHEN s_acctbal >= 0 AND s_suppkey % 3 = 0 THEN s_name || ' GmbH' END AS organisation FROM supplier""")
def submitters_classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitters classed at the scan: only organisations keep their name, a flag may veto."""
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit(" GmbH"))).otherwise(F.col("s_name"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"), (F.col("s_acctbal") >= 0).alias("public"))
    return privacy.without_persons(s, "name", "public", ["s_suppkey"])


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS class, count_if(user_id % 5 <> 0) AS readers, count_if(user_id % 5 = 0) AS bots FROM events GROUP BY CAST(ts AS DATE), event_type""")
def usage_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per UTC day and class, robots apart: the batch form of the streaming count."""
    agent = F.when(F.col("user_id") % 5 == 0, F.lit("SomeBot/1.0")).otherwise("Mozilla/5.0")
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("class"), agent.alias("agent"))
    return usage.daily_usage(e).withColumn("day", F.col("day").cast("string"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS k, event_id AS id, epoch_us(ts) / 1000.0 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT k, id, n, ms, CAST(1 AS DOUBLE) AS tokens, false AS refused FROM e WHERE n = 1
  UNION ALL SELECT k, id, n, ms, CASE WHEN now < 1 THEN now ELSE now - 1 END, now < 1 FROM (SELECT e.k, e.id, e.n, e.ms, least(2, tokens + greatest(0, e.ms - b.ms) * 0.001 / 60000) AS now FROM b JOIN e ON e.k = b.k AND e.n = b.n + 1))
SELECT CAST(k AS VARCHAR) AS key, id, refused FROM b""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user through a token bucket: the batch form of the stateful stream."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return usage.token_bucket_batch(e, 2, 0.001).select("key", "id", (F.col("wait") > 0).alias("refused"))


@query(f"""WITH {DRAFTS_SQL} SELECT day, title FROM (SELECT CAST(arrived AS VARCHAR) AS day, title || ' <' || inr || '>' AS title, row_number() OVER (ORDER BY arrived DESC, '<item><title>' || title || ' &lt;' || inr || '&gt;</title>') AS r FROM d) WHERE r <= 20""".replace("SELECT day, title FROM", "SELECT day, replace(replace(title, '<', '&lt;'), '>', '&gt;') AS title FROM"))
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty drafts as escaped feed items."""
    d = drafts(spark, sf_dir).select("arrived", F.concat("title", F.lit(" <"), F.col("inr").cast("string"), F.lit(">")).alias("title"), F.concat(F.lit("/d/"), F.col("inr").cast("string")).alias("link"))
    top = sinks.newest_first(sinks.rss_items(d, "title", "link", "arrived"), 20)
    return top.select(F.col("day").cast("string").alias("day"), F.regexp_extract("item", "<title>(.*)</title>", 1).alias("title"))


@query(f"""WITH {DRAFTS_SQL} SELECT inr, array_to_string(['BEGIN:VEVENT', 'UID:' || inr, 'DTSTART;VALUE=DATE:' || strftime(deadline, '%Y%m%d'), 'SUMMARY:Frist\\; ' || title || '\\, ' || ministry, 'END:VEVENT'], chr(13) || chr(10)) AS event FROM d WHERE deadline IS NOT NULL""")
def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines as all-day events; their lines are shorter than the fold."""
    d = drafts(spark, sf_dir).where("deadline IS NOT NULL").select("inr", "deadline", F.concat(F.lit("Frist; "), "title", F.lit(", "), "ministry").alias("summary"))
    return sinks.ics_events(d, "inr", "deadline", "summary")


_ITEM_KEY = "'<item><title>' || title || '</title><link>/d/' || inr || '</link>'"


@query(f"""WITH {DRAFTS_SQL} SELECT '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>Drafts</title><link>/</link><lastBuildDate>' || strftime(max(arrived), '%a, %d %b %Y') || ' 00:00:00 GMT</lastBuildDate>'
  || string_agg({_ITEM_KEY} || '<pubDate>' || strftime(arrived, '%a, %d %b %Y') || ' 00:00:00 GMT</pubDate></item>', '' ORDER BY arrived DESC, {_ITEM_KEY}) || '</channel></rss>' AS document
FROM (SELECT * FROM d ORDER BY arrived DESC, {_ITEM_KEY} LIMIT 20)""")
def feed_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feed of the newest twenty drafts in its envelope."""
    d = drafts(spark, sf_dir).select("arrived", "title", F.concat(F.lit("/d/"), F.col("inr").cast("string")).alias("link"))
    return sinks.feed_document(sinks.newest_first(sinks.rss_items(d, "title", "link", "arrived"), 20), "Drafts", "/")


@query("""SELECT DISTINCT '<url><loc>https://x.example' || replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') || '</loc></url>' AS url FROM pages WHERE url IS NOT NULL""")
def site_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses of the site map, escaped."""
    return sinks.sitemap(table(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.col("url").alias("path")), "https://x.example")


@query("""SELECT p_partkey AS id, md5(p_name) AS name_md5 FROM part""")
def strong_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong tags of bodies beside a digest of them: equal bodies alone have equal tags."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", sinks.strong_tag(F.col("p_name")).alias("tag"))
    tags = p.groupBy("tag").agg(F.count_distinct("p_name").alias("bodies"))
    right = (F.col("bodies") == 1) & F.col("tag").rlike('^"[0-9a-f]{16}"$')
    return p.join(tags, "tag").select("id", F.when(F.assert_true(right, F.lit("two bodies have one tag")).isNull(), F.md5("p_name")).alias("name_md5"))


@query("""SELECT o_orderkey AS inr, o_orderstatus AS status, o_totalprice AS price FROM orders""")
def positional_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a list document read by position under a checked header, then checked against the key that was asked for."""
    o = table(spark, sf_dir, "orders")
    row = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_totalprice").cast("string"), F.lit("28"))
    header = F.array(*map(F.lit, ["inr", "status", "price", "slot", "more"]))
    pages = o.groupBy(F.floor(F.col("o_orderkey") / 1000)).agg(F.collect_list(row).alias("rows")).select(header.alias("header"), "rows")
    raw = pages.select(F.from_json(F.to_json(F.struct("header", "rows")), scans.LIST_SCHEMA).alias("d")).select("d.*")
    got = scans.positional_rows(raw, ["inr", "status", "price", "slot"], {"inr": "long", "price": "double", "slot": "int"})
    return scans.rechecked(got, {"slot": 28}).select("inr", "status", "price")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 1 AS many FROM events""")
def drifting_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON whose shape drifts, and a bare value read as an array of one."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", *scans.drifting(F.col("props"), {"k": ("$.k", "long")}), F.size(scans.one_or_many(F.col("props"), "$.k", "long")).alias("many"))


@query("""SELECT 'http://register.example/act/' || c_custkey AS act, CASE WHEN c_acctbal >= 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS n, c_name AS label FROM customer""")
def result_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings of a graph query's answers, a hundred to an answer, as rows; a variable may be unbound."""
    c = table(spark, sf_dir, "customer")
    node = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    act = F.concat(F.lit("http://register.example/act/"), F.col("c_custkey").cast("string"))
    bound = F.struct(node("uri", act).alias("act"), F.when(F.col("c_acctbal") >= 0, node("literal", F.floor("c_acctbal").cast("string"))).alias("n"), node("literal", F.col("c_name")).alias("label"))
    answers = c.groupBy(F.floor(F.col("c_custkey") / 100)).agg(F.struct(F.collect_list(bound).alias("bindings")).alias("results"))
    head = F.struct(F.array(*map(F.lit, ("act", "n", "label"))).alias("vars"))
    raw = answers.select(F.to_json(F.struct(head.alias("head"), "results")).alias("j")).select(scans.strict_json(F.col("j"), scans.BINDINGS_SCHEMA).alias("d")).select("d.*")
    return scans.bindings(raw, ["act", "n", "label"])


@query("""SELECT page, count(*) AS n, min(o_orderkey) AS first_key, max(number) AS last_number FROM (SELECT *, file_row_number // 1000 AS page, (SELECT count(*) FROM orders) - 1 - file_row_number AS number FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS file_row_number FROM orders)) WHERE o_orderkey >= 200 AND o_totalprice < 400000 GROUP BY 1""")
def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through a connector with a partition per page and pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    orders = pages.listed(spark, f"{sf_dir}/orders.parquet", 1000).where("o_orderkey >= 200 AND o_totalprice < 400000")
    return orders.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("number").alias("last_number"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def repaired_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paged read that shifted (a record twice, another one skipped) made whole by reading those days again: its records."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("pos"))
    day = o.where("o_orderkey = 10").select("day")
    of_day = o.join(day, "day", "left_semi")
    lost = of_day.agg(F.max("o_orderkey").alias("o_orderkey")).where("o_orderkey <> 10")
    pages = o.join(lost, "o_orderkey", "left_anti").unionByName(o.where("o_orderkey = 10"))
    return scans.repaired(pages, "o_orderkey", "day", 0, lambda days: o.join(days, "day", "left_semi"))[0].select("o_orderkey", F.col("day").cast("string").alias("day"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END AS o_totalprice, 2 AS version FROM orders WHERE (o_orderkey % 3 = 0 AND o_orderstatus <> 'P') OR o_orderkey % 5 = 0""")
def fact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after a refresh: fresh complete rows win, stored ones of the same version stay."""
    o = table(spark, sf_dir, "orders")
    fresh = o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") != "P").alias("complete"))
    stored = o.select("o_orderkey", F.lit(0.0).alias("o_totalprice"), F.lit(True).alias("complete"), F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1).alias("version"))
    return sinks.upsert(stored, fresh, ["o_orderkey"], 2).select("o_orderkey", "o_totalprice", "version")


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, max(event_id) AS stamp FROM events GROUP BY CAST(ts AS DATE)""")
def partial_and_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partial aggregates of the days merged to the whole."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), "event_id")
    part = lambda d: d.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("stamp"))
    return sinks.merged_days(part(e.where("event_id % 2 = 0")), part(e.where("event_id % 2 = 1")), ["day"], "n", "stamp")


@query(f"""WITH {DRAFTS_SQL}, a AS (SELECT DISTINCT l_orderkey AS inr, l_partkey AS act FROM lineitem), w AS (SELECT l_orderkey AS inr, bool_or(l_returnflag = 'A') AS via_bill, bool_or(l_returnflag = 'R') AS exempt FROM lineitem GROUP BY 1)
SELECT class, count(*) AS n FROM (SELECT CASE WHEN w.via_bill THEN 'consulted' WHEN w.exempt THEN 'exempt' WHEN l.quality IS NULL THEN 'unknown' ELSE 'none' END AS class FROM d LEFT JOIN w USING (inr) LEFT JOIN labels l ON l.doc_id = d.inr % 1000) GROUP BY 1""")
def laws_without_consultation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered evidence: consulted, exempt, unknown where a side was not read, else none."""
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("inr")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("via_bill"), F.bool_or(F.col("l_returnflag") == "R").alias("exempt"))
    read = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("slot"), "quality")
    d = drafts(spark, sf_dir).join(w, "inr", "left").withColumn("slot", F.col("inr") % 1000).join(read, "slot", "left")
    kind = F.when(F.col("via_bill"), "consulted").when(F.col("exempt"), "exempt").when(F.col("quality").isNull(), "unknown").otherwise("none")
    return d.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT item_id, lower(text) AS core FROM benchmark)
SELECT item_id, count(*) AS docs, min(doc_id) AS first_doc FROM c JOIN documents ON contains(lower(text), core) GROUP BY 1""")
def title_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores (here whole passages) that occur in documents.

    The longest run of three whole words of a core is looked up by equality among the documents' three-word runs, then the
    whole core is confirmed. Cores of fewer than five words have no such run: they are looked up by three of their characters,
    and those of fewer characters, which cannot be many, in every document.
    """
    # A core may begin or end inside a word; the words between are whole.
    cores = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.lower("text").alias("core")).withColumn("w", F.split("core", r"\s"))
    long = cores.where(F.size("w") >= 5)
    inner = F.transform(F.sequence(F.lit(2), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 3), " "))
    run = F.array_max(F.transform(inner, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]
    keyed = long.select("item_id", "core", run.alias("run"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    words = docs.select("doc_id", F.split("low", r"\s").alias("w"))
    runs = words.where(F.size("w") >= 3).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " ")))).alias("run"))
    asked = runs.join(keyed, "run").select(F.col("doc_id").alias("_id"), "item_id", "core").distinct()
    met = asked.join(docs, F.col("doc_id").eqNullSafe(F.col("_id")) & F.contains("low", F.col("core"))).select("item_id", "doc_id")
    few = cores.where("size(w) < 5").select("item_id", "core")
    triples = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    by_three = few.where(F.length("core") >= 3).select("item_id", "core", F.array_max(triples("core")).alias("three"))
    held = docs.where(F.length("low") >= 3).select("doc_id", "low", F.explode(triples("low")).alias("three")).join(by_three.select("three").distinct(), "three", "left_semi")
    short = held.join(by_three, "three").where(F.contains("low", F.col("core"))).select("item_id", "doc_id")
    tiny = few.where(F.length("core") < 3).groupBy("core").agg(F.collect_list("item_id").alias("items"))
    least = docs.join(F.broadcast(tiny), F.contains("low", F.col("core"))).select(F.explode("items").alias("item_id"), "doc_id")
    return met.unionByName(short).unionByName(least).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))


@query("""SELECT region, k, CAST(rank AS INTEGER) AS rank FROM (SELECT r_name AS region, o_orderkey AS k, row_number() OVER (PARTITION BY r_name ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) WHERE rank <= 5""")
def newest_per_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest drafts of each publisher."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ordered.top_per_group(o.select(F.col("r_name").alias("region"), F.col("o_orderkey").alias("k"), "o_orderdate"), ["region"], [F.desc("o_orderdate"), F.col("k")], 5).select("region", "k", "rank")


@query("""SELECT priority, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY days) AS BIGINT) AS median_days, count(*) AS n, count_if(days <= 180) / count(*) AS within_180 FROM (
  SELECT o_orderpriority AS priority, CAST(min(l_shipdate) AS DATE) - CAST(any_value(o_orderdate) AS DATE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority HAVING min(l_shipdate) > any_value(o_orderdate)) GROUP BY 1""")
def latency_base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to the first later step: exact median and the share within 180 days."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    o = first.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("first_ship > o_orderdate")
    o = o.select(F.col("o_orderpriority").alias("priority"), F.datediff(F.to_date("first_ship"), F.to_date("o_orderdate")).alias("days"))
    return o.groupBy("priority").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY days)").cast("long").alias("median_days"), F.count(F.lit(1)).alias("n"), (F.count_if(F.col("days") <= 180) / F.count(F.lit(1))).alias("within_180"))


@query()
def approximate_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct users and top users per event type, for reports where exact counts are not asked for."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5, 1000).alias("median_value"))
