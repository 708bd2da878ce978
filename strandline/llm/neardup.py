"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its word shingles, each hashed once; its sketch is the
smallest hashes. Inverted lists hold documents under retained values; documents
that meet in a list are candidates, the bottom-k sketch of their union estimates
the similarity, and the full sets confirm it.

Why no link is lost: of the ``INDEXED`` smallest values of two sets with Jaccard
similarity t, at least ``shared_values(t)`` are in both, but for a chance below 1e-6
(sets of at most ``INDEXED`` shingles are known whole, and for them it is certain).
If both orders their values alike, one of the first ``INDEXED`` - shared + 1 of
each is common. The order is by document frequency: values of one document
alone come first and need no list, values of a line that very many documents
have come last and are listed only for documents that hold little else. The
estimate is cut 5.5 standard deviations below the threshold.

Why lists of many documents are not expanded: equal sets are one class from the
start; within a list, documents are compared with one centre first; only lists
that still hold several components compare members of different components.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import BLANK, joined_salted, joined_spread, let, materialize, word_list
from strandline.llm.components import components

SHINGLE = 5
PERCENT = 80
SKETCH = 128
INDEXED = 48
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_set(text: Column, width: int) -> Column:
    """The sorted distinct 64-bit hashes of a text's shingles of ``width`` words.

    A-Z are lower-cased. Fewer words than ``width`` make one shingle, no words none.
    """
    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        runs = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(width)]))
        return F.when(n >= width, F.sort_array(F.array_distinct(runs))).when(n > 0, F.array(F.xxhash64(F.lit("short"), hashes))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(word_list(F.translate(text, _UPPER, _LOWER)), lambda w: F.xxhash64(w)), of)


def shared_values(percent: int) -> int:
    """How many of ``INDEXED`` values two sets at the threshold share at least: 5.3 standard deviations below the mean."""
    t = percent / 100
    return math.floor(INDEXED * t - 5.3 * math.sqrt(INDEXED * t * (1 - t)))


def summaries(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and its ``INDEXED`` smallest values, of every row."""
    parts = let(shingle_set(F.col("text"), width), lambda s: F.struct(F.size(s).cast("long").alias("n_shingles"), F.xxhash64(s).alias("h1"), F.xxhash64(F.lit("second"), s).alias("h2"), F.slice(s, 1, INDEXED).alias("low")))
    return docs.select("doc_id", parts.alias("p")).select("doc_id", "p.*")


def inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """Members of the lists (key, node, n) of classes (node, n, low): each under the rarest of its values that it may have to share.

    Values are counted before they are joined back, so a value that a third of
    all documents hold is never gathered.
    """
    listed = classes.select("node", "n", F.explode("low").alias("key"))
    known = listed.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    met = joined_spread(listed, known, ["key"], "df").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("met"))
    size = F.least("n", F.lit(INDEXED))
    must = F.least(F.ceil(F.col("n") * percent / 100), F.lit(shared_values(percent)))
    # Of the first size - must + 1 values, those that no other document has need no list.
    places = (size - must + 1 - (size - F.size("met"))).cast("int")
    kept = met.where(places > 0).select("node", "n", F.explode(F.slice("met", 1, places)).alias("m"))
    return kept.select("node", "n", F.col("m.key").alias("key"))


def estimate_floor(percent: int) -> float:
    """What the union sketch must show at least for a pair at the threshold."""
    t = percent / 100
    return t - 5.5 * math.sqrt(t * (1 - t) / SKETCH)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b: nodes) whose sets are similar enough: estimate by union sketch, then count exactly."""
    def joined(pairs: DataFrame, value: Column) -> DataFrame:
        side = sets.select("node", value.alias("v"))
        # Pairs (a, b) of a centre are many: its set is dealt in copies. A b has few pairs.
        one = joined_salted(pairs, side.select(F.col("node").alias("a"), F.col("v").alias("va")), "a")
        return one.join(side.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")

    sketched = joined(pairs, F.slice("s", 1, SKETCH))
    union = F.slice(F.sort_array(F.array_union("va", "vb")), 1, SKETCH)
    shared = let(union, lambda u: F.size(F.array_intersect(F.array_intersect(u, F.col("va")), F.col("vb"))) / F.size(u))
    likely = materialize(sketched.where(shared >= estimate_floor(percent)).select("a", "b"), "likely")
    both = F.size(F.array_intersect("va", "vb"))
    return joined(likely, F.col("s")).where(let(both, lambda i: 100 * i >= percent * (F.size("va") + F.size("vb") - i))).select("a", "b")


def linked_classes(docs: DataFrame, found: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (h1, h2, node, n_shingles) and the components of their nodes.

    A node is the struct (nameless, id, h1) of the class's smallest doc_id, so that
    repeated ids with different texts stay apart. Rows without an id count only
    in classes where no row has one; these nodes come after all others.
    """
    node = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("h1").alias("h1"))
    classes = materialize(found.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min(node).alias("node"), F.first("n_shingles").alias("n"), F.first("low").alias("low"), F.count(F.lit(1)).alias("copies")), "classes")
    # A set of n shingles has no similar different set if n / (n + 1) is below the threshold.
    least = math.ceil(percent / (100 - percent) - 1e-9)
    listed = materialize(inverted_lists(classes.where(F.col("n") >= least), percent), "listed")
    shared = listed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("centre"), F.min_by("n", "node").alias("centre_n")).where("members > 1")
    lists = materialize(joined_spread(listed, shared, ["key"], "members"), "lists")
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    stars = materialize(lists.where((F.col("node") != F.col("centre")) & fits(F.col("n"), F.col("centre_n"))).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    # Every member of a list may have to be compared, so its set is computed once.
    ids = lists.select(F.col("node.id").alias("doc_id"), F.col("node.h1").alias("h1")).distinct()
    asked = ids.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"))
    again = docs.join(asked.select("_id").distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("doc_id", shingle_set(F.col("text"), width).alias("s"))
    sets = again.withColumn("h1", F.xxhash64("s")).join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h1") == F.col("_h1")), "left_semi")
    sets = materialize(sets.groupBy("doc_id", "h1").agg(F.first("s").alias("s")).select(F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), "h1").alias("node"), "s"), "sets")
    edges = materialize(confirmed(stars, sets, percent), "links")
    labels = components(edges)
    # Lists of three and more that still hold several components: their members across components.
    named = lists.where("members > 2").select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = named.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.count(F.lit(1)).alias("held")).where("first <> last").select("key", "held")
    members = materialize(joined_spread(named, several, ["key"], "held").select("node", "component").distinct(), "open")
    rest = materialize(prefix_pairs(members, sets, percent).join(stars, ["a", "b"], "left_anti"), "rest")
    more = confirmed(rest, sets, percent)
    return classes, components(edges.unionByName(more))


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (node, component) from different components that may be similar enough.

    With each set in the order of how many members hold a shingle, rarest first,
    two similar sets share one of their first n - ceil(t * n) + 1 shingles, and from their
    first common shingle on as many are left as the threshold asks for. So a
    cloud of texts, each edited at random from one, whose pairs lie just below
    the threshold, meets under common shingles, but only behind its own edits.
    """
    shingles = materialize(sets.join(members, "node").select("node", "component", F.explode("s").alias("h")), "shingles")
    held = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("holders"))
    ordered = joined_spread(shingles, held, ["h"], "holders").groupBy("node", "component").agg(F.sort_array(F.collect_list(F.struct("holders", "h"))).alias("o"))
    n = F.size("o").cast("long")
    first = F.slice("o", 1, (n - F.ceil(n * percent / 100) + 1).cast("int"))
    listed = ordered.select("node", "component", n.alias("n"), F.posexplode(first).alias("at", "x")).where("x.holders > 1").select("node", "component", "n", "at", F.col("x.h").alias("h"))
    listed = materialize(listed, "prefixes")
    other = listed.select("h", F.col("node").alias("b"), F.col("component").alias("other"), F.col("n").alias("m"), F.col("at").alias("bt"))
    left = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt"))
    near = (100 + percent) * left >= percent * (F.col("n") + F.col("m"))
    return listed.join(other, "h").where((F.col("node") < F.col("b")) & (F.col("component") != F.col("other")) & near).select(F.col("node").alias("a"), "b").distinct()


def named_classes(docs: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """Classes (h1, h2) with component_id (null if no row of the component has an id) and ``stands``: the class stands for such a component."""
    classes, labels = linked_classes(docs, found, width, percent)
    component = F.coalesce("component", "node")
    return classes.join(labels, "node", "left").select("h1", "h2", "copies", component["id"].alias("component_id"), (component["nameless"] & (component == F.col("node"))).alias("stands"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Component of every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id reachable. Null and blank
    texts have no shingles and are linked with nothing. Rows with a null doc_id
    get the component of their text and are not kept if a row of it has an id.
    In a component without any id, component_id is null and one row is kept;
    blank texts with a null doc_id are each kept.
    Repeated rows are returned each; other columns of ``docs`` are ignored.
    """
    docs = docs.select("doc_id", "text")
    found = materialize(summaries(docs, width), "summaries")
    of_class = materialize(named_classes(docs, found, width, percent), "components")
    full = joined_spread(found.where("n_shingles > 0").select("doc_id", "n_shingles", "h1", "h2"), of_class, ["h1", "h2"], "copies").drop("copies")
    one = full.where("stands").groupBy("h1", "h2", "doc_id", "n_shingles", "component_id").agg(F.count(F.lit(1)).alias("n"))
    one = one.select("doc_id", "n_shingles", "component_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).withColumn("kept", F.col("i") == 1)
    rest = full.where("NOT stands").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    blank = found.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("kept", F.lit(True))
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    return rest.select(*columns).unionByName(one.select(*columns)).unionByName(blank.select(*columns))


def keep_first(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component: the rows of ``docs`` with its smallest doc_id.

    Rows that share a doc_id are one document and stay or go together. A row with
    a null doc_id is a document of its own: of a component without any id one
    row stays, and blank texts stay.
    """
    texts = docs.select("doc_id", "text")
    found = materialize(summaries(texts, width), "summaries")
    of_class = materialize(named_classes(texts, found, width, percent), "components")
    full = joined_spread(found.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "h1", "h2"), of_class, ["h1", "h2"], "copies").where("doc_id = component_id")
    kept = full.select("doc_id").unionByName(found.where("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id")).distinct()
    # Rows without an id cannot be asked for by id, so their hashes are computed again.
    s = let(shingle_set(F.col("text"), width), lambda s: F.struct(F.size(s).alias("n"), F.xxhash64(s).alias("h1"), F.xxhash64(F.lit("second"), s).alias("h2")))
    nameless = docs.where("doc_id IS NULL").select(F.struct("*").alias("row"), s.alias("s")).select("row", "s.*")
    standing = nameless.where("n > 0").join(of_class.where("stands").select("h1", "h2"), ["h1", "h2"])
    one = standing.groupBy("h1", "h2").agg(F.min_by("row", "row.text").alias("row"))
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(one.select("row.*")).unionByName(nameless.where("n = 0").select("row.*"))


#: ``near_duplicates`` of ``documents`` with three-word shingles and 85 percent.
ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{BLANK}'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) END AS sh FROM w
), c AS (
  SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh
), x AS (
  SELECT rep, n, unnest(sh) AS k FROM c
), p AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.k = b.k AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), r AS (
  SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen
), m AS (
  SELECT node, min(seen) AS component FROM r GROUP BY node
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, coalesce(m.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN m ON m.node = c.rep
"""
