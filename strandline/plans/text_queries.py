"""Text and page queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import arrow_text, dates, text
from strandline.plans.base import registry, table

QUERIES, SQL, query = registry()


@query(r"""SELECT page_id, url, lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)) AS host,
  CASE WHEN regexp_matches(url, '(?i)^https?://') AND regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1) <> '' THEN regexp_replace(url, '(?i)^http://', 'https://') END AS guarded FROM pages""")
def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses upgraded to https, with their host."""
    return table(spark, sf_dir, "pages").select("page_id", "url", text.url_host(F.col("url")).alias("host"), text.guarded_url(F.col("url")).alias("guarded"))


@query(r"""SELECT page_id, len(links) AS n_links, coalesce(links[1], '') AS first_link, nullif(trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM (SELECT page_id, html, regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href=["'']([^"'']*)["'']', 1) AS links FROM pages)""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and title of every page."""
    p = table(spark, sf_dir, "pages").select("page_id", text.html_links(F.col("html")).alias("links"), text.html_title(F.col("html")).alias("title"))
    return p.select("page_id", F.size("links").cast("long").alias("n_links"), F.coalesce(F.get("links", F.lit(0)), F.lit("")).alias("first_link"), "title")


@query(r"""SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page: length and digest."""
    p = table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(translate(replace(translate(lower(coalesce(text, '')), 'äöü', 'aou'), 'ß', 'ss'), 'àáâãåçèéêëìíîïñòóôõøùúûýÿ', 'aaaaaceeeeiiiinooooouuuyy'), 'ae', 'a'), 'oe', 'o'), 'ue', 'u'), '[^a-z0-9]+', ' ', 'g'))) AS folded FROM documents""")
def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's search form."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@query("""SELECT doc_id, n_hits, first_at FROM (SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'licen', ''))) / 5 AS BIGINT) AS n_hits, CAST(strpos(lower(text), 'licen') AS BIGINT) AS first_at FROM documents) WHERE n_hits > 0""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a search term, how often and where first."""
    low = F.lower("text")
    hits = (F.length(low) - F.length(F.replace(low, F.lit("licen"), F.lit("")))) / 5
    return table(spark, sf_dir, "documents").select("doc_id", hits.cast("long").alias("n_hits"), F.locate("licen", low).cast("long").alias("first_at")).where("n_hits > 0")


@query()
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of a term with its surroundings, cut at word borders, and the line that holds it."""
    d = table(spark, sf_dir, "documents").where(F.lower("text").contains("license"))
    line = F.element_at(F.filter(F.split("text", "\n"), lambda x: F.lower(x).contains("license")), 1)
    return d.select("doc_id", text.snippet(F.col("text"), "license").alias("snippet"), text.shorten(line, 60).alias("line"))


@query("""SELECT doc_id, block, every_term FROM (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS block, contains(b, 'the') AND contains(b, 'and') AS every_term, row_number() OVER (PARTITION BY doc_id ORDER BY contains(b, 'the') AND contains(b, 'and') DESC, i) AS r
  FROM (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS b, generate_subscripts(string_split(lower(text), chr(10)), 1) AS i FROM documents)
  WHERE contains(b, 'the') OR contains(b, 'and')) WHERE r = 1""")
def locate_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block with all terms, else the first with any."""
    b = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("block", "b"))
    every = F.col("b").contains("the") & F.col("b").contains("and")
    some = b.where(F.col("b").contains("the") | F.col("b").contains("and")).withColumn("every_term", every)
    best = some.groupBy("doc_id").agg(F.min(F.struct((~F.col("every_term")).alias("only_any"), "block")).alias("m"))
    return best.select("doc_id", F.col("m.block").cast("long").alias("block"), (~F.col("m.only_any")).alias("every_term"))


@query(r"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(coalesce(text, ''), '\b(\d{1,4}/\d{2,4})\b', 1))) AS BIGINT) AS n_citations,
  CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS n_capitals FROM documents""")
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct citations and capitalised words of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.citations(F.col("text"))).cast("long").alias("n_citations"), F.regexp_count("text", F.lit("[A-Z][a-z]+")).cast("long").alias("n_capitals"))


@query("""SELECT p_partkey AS id, replace(replace(replace(p_name || ' <&> "' || p_brand || '"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped,
  CAST(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS INTEGER) AS number FROM part""".replace("\\\\", "\\").replace("p_brand || '\"'", "p_brand || '\"'").replace("AS escaped", "AS escaped_open"))
def escaped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names escaped for XML text, and the number in a brand."""
    raw = F.concat(F.col("p_name"), F.lit(' <&> "'), F.col("p_brand"), F.lit('"'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(text.xml_escape(raw), F.lit("&quot;"), F.lit('"')).alias("escaped_open"), F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("int").alias("number"))


@query("""SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CASE WHEN days < 21 THEN 'short' WHEN days < 42 THEN 'shortened' ELSE 'full' END AS class FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 60 AS days FROM orders)""")
def parsed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days read back from three spellings, and the class of a deadline after them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    spelled = F.when(F.col("id") % 3 == 0, F.date_format("d", "d.M.yyyy")).when(F.col("id") % 3 == 1, F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("T10:00:00Z"))).otherwise(F.date_format("d", "yyyyMMdd"))
    o = o.withColumn("day", dates.parse_day(spelled))
    return o.select("id", F.col("day").cast("string").alias("day"), dates.deadline_class(F.col("day"), F.date_add("day", (F.col("id") % 60).cast("int"))).alias("class"))


@query("""SELECT p_partkey AS id, CASE WHEN n > 0 THEN repeat('M', n // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] END AS numeral,
  CASE WHEN n > 0 AND n % 7 > 0 THEN n END AS value FROM (SELECT p_partkey, CAST(p_partkey * 7919 % 4000 AS INTEGER) AS n FROM part)""")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as Roman numerals and back; every seventh numeral is spoilt by four equal letters, which no number has."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 4000).cast("int").alias("n"))
    numeral = text.to_roman(F.col("n"))
    spoilt = F.when(F.col("n") % 7 == 0, F.concat(numeral, F.lit("IIII"))).otherwise(numeral)
    return p.select("id", numeral.alias("numeral"), text.roman(spoilt).alias("value"))


@query("""SELECT p_partkey AS id, list_reduce(list_prepend(2166136261, list_transform(range(1, octet_length(encode(name)) + 1), lambda i: CAST(('0x' || substr(hex(encode(name)), 2 * i - 1, 2)) AS BIGINT))), lambda h, b: xor(h, b) * 16777619 % 4294967296) AS hash FROM (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_partkey AS name FROM part)""")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of every part's name, exact in 32 bits."""
    name = F.concat_ws(" ", "p_name", "p_type", F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.fnv1a32(name).alias("hash"))


@query("""SELECT conv_id, turn, NOT regexp_matches(text, '[A-Za-z]') AS no_words, CASE WHEN regexp_matches(lower(text), 'thank|please') THEN 'polite' WHEN contains(text, '?') THEN 'question' ELSE 'other' END AS kind FROM conversations""")
def rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules: the first that holds names the class."""
    t = F.col("text")
    kind = F.when(F.lower(t).rlike("thank|please"), "polite").when(t.contains("?"), "question").otherwise("other")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (~t.rlike("[A-Za-z]")).alias("no_words"), kind.alias("kind"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional reads of a JSON column under a declared schema."""
    p = F.from_json("props", "k long, missing string")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), p["missing"].alias("missing"))


@query()
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document, aware of abbreviations, and the one that holds a term."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(arrow_text.sentences(F.col("text"))).alias("sentences"), arrow_text.quote_around(F.col("text"), "license").alias("quote"))


@query()
def match_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of all hits of a query in the original texts, by folded forms."""
    d = table(spark, sf_dir, "documents").where(F.lower("text").contains("license"))
    return d.select("doc_id", F.explode(arrow_text.match_ranges(F.col("text"), ["license", "licensed"])).alias("r")).select("doc_id", "r.*")


@query("""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('„' || text || '“ –  § ' || turn || 'b.', '[\\x{00AD}\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]', '', 'g'), '[„“”«»]', '"', 'g'), '[‚‘’]', chr(39), 'g'), '[–—−]', '-', 'g'), '[\\s\\x{00A0}]+', ' ', 'g')) AS form, turn || 'b' AS designation FROM conversations WHERE text IS NOT NULL AND NOT contains(text, '§')""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typographic form of quotes, dashes, blanks and invisible characters, and the designation that a text holds."""
    c = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull() & ~F.contains("text", F.lit("§")))
    written = F.concat(F.lit("„"), "text", F.lit("“ –\u00a0 § "), F.col("turn").cast("string"), F.lit("b."))
    return c.select("conv_id", "turn", text.typographic(written).alias("form"), text.designation(written).alias("designation"))


@query("""SELECT doc_id, strlen(text) AS n, text IS NOT NULL AND contains(lower(source || ' ' || lang || ' ' || coalesce(text, '')), 'en ') AS hit FROM documents""")
def haystacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable text of each document out of several columns, and whether it holds a term."""
    d = table(spark, sf_dir, "documents")
    hay = F.lower(text.haystack(F.col("source"), F.col("lang"), F.col("text")))
    return d.select("doc_id", F.octet_length("text").cast("long").alias("n"), (F.col("text").isNotNull() & F.contains(hay, F.lit("en "))).alias("hit"))
