"""Document fingerprints by Order MinHash.

A text's k-mers (``K`` words in a row) are numbered by occurrence, so that
repeats count. For each of ``SKETCHES`` orders of these numbered k-mers, the
``TUPLE`` least are kept, put back into text order and hashed; two texts agree
in an entry if they share these k-mers and their order, which falls with the
edit distance and not only with the overlap.

The orders are drawn independently of each other, but not by hashing every
k-mer once for every order: a k-mer throws darts. Dart c of a k-mer falls on a
hashed order with value c + a hashed fraction, so a k-mer's value in an order
is that of its first dart there, and the least k-mers of an order are those
with the least darts on it. Which k-mer is least depends on the k-mers alone;
only how many darts must be looked at depends on a text's length: about
``DARTS`` for each order in all, by fewer rounds and at last a threshold as
texts get longer. The work is in proportion to a text's words and ``SKETCHES``
* ``DARTS``, and a text of a few words has as many distinct orders as a long one.

Everything is built-in array arithmetic on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import let, materialize, word_list

K = 3
TUPLE = 2
SKETCHES = 64
#: Darts on each order that are looked at, on average. An order with fewer than TUPLE k-mers among them (about
#: one in 10**5) is hashed from those it has.
DARTS = 15
#: Bits of a dart from the top: its order, its round, its fraction, and the place of its k-mer.
ORDER_BITS, ROUND_BITS, PART_BITS, PLACE_BITS = 6, 10, 30, 18
_PART = ((1 << PART_BITS) - 1) << PLACE_BITS
_ORDER = ~((1 << (64 - ORDER_BITS)) - 1)
_ROUND = 1 << (PART_BITS + PLACE_BITS)
#: Darts of an order among which the TUPLE least k-mers are sought (a text of few k-mers: all).
LOOKED_AT = 8


def kmers(hashes: Column) -> Column:
    """The 64-bit hash of each k-mer in text order; a text of fewer than ``K`` words is one k-mer."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(1), n - K + 1), lambda i: F.xxhash64(*[F.get(hashes, i + k - 1) for k in range(K)]))
    whole = F.array(F.xxhash64(F.lit("short"), hashes))
    return F.when(n >= K, runs).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))


def numbered(found: Column) -> Column:
    """A hash of each k-mer and its occurrence number, in text order.

    Without repeats all numbers are 0. Else k-mers are sorted by hash and place;
    each points to its predecessor if that is equal; doubling the pointers finds
    the first of each run, and the distance to it is the occurrence number.
    """
    first = F.transform(found, lambda h: F.xxhash64(h, F.lit(0)))

    def by_run(s: Column) -> Column:
        pointers = F.transform(s, lambda x, j: F.when((j > 0) & (x["h"] == F.get(s, F.greatest(j - 1, F.lit(0)))["h"]), j - 1).otherwise(j))
        repeats = lambda p: F.size(F.filter(p, lambda x, j: x < j))
        doubled = lambda p: F.aggregate(F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(repeats(p) + 1)).cast("int"), F.lit(1))), p, lambda q, _: F.transform(q, lambda x: F.get(q, x)))
        return let(let(pointers, doubled), lambda p: F.transform(s, lambda x, j: F.struct(x["place"].alias("place"), F.xxhash64(x["h"], j - F.get(p, j)).alias("id"))))

    repeated = let(F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("place")))), by_run)
    return F.when(F.size(F.array_distinct(found)) == F.size(found), first).otherwise(F.transform(F.sort_array(repeated), lambda x: x["id"]))


def darts(ids: Column) -> Column:
    """Packed (order, round, fraction, place) of the darts to be looked at, sorted.

    A text of more than ``SKETCHES`` * ``DARTS`` k-mers has one round, of which
    darts above a threshold are left out at once; its places take the round's bits.
    """
    n = F.size(ids)
    wanted = SKETCHES * DARTS
    # With m k-mers, an order lacks a second one if all but one have no dart on it.
    rounds = F.least(F.ceil(F.lit(float(wanted)) / F.greatest(n - 1, F.lit(1))), F.lit(1 << ROUND_BITS)).cast("long")
    limit = (F.lit(float(wanted)) / n * (1 << PART_BITS)).cast("long") * F.lit(1 << PLACE_BITS)
    hashed = lambda c: F.transform(ids, lambda x: F.xxhash64(x, c))
    # The round's number, already in its place, is what is hashed with the k-mer.
    many = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), (rounds - 1) * _ROUND, F.lit(_ROUND)), lambda c: F.transform(hashed(c), lambda r, j: r.bitwiseAND(F.lit(_ORDER | _PART)).bitwiseOR(c).bitwiseOR(j.cast("long")))))
    near = F.filter(F.transform(hashed(F.lit(0).cast("long")), lambda r, j: F.struct(r.alias("r"), j.alias("j"))), lambda d: d["r"].bitwiseAND(F.lit(_PART)) < limit)
    single = F.transform(near, lambda d: d["r"].bitwiseAND(F.lit(_ORDER)).bitwiseOR(F.shiftleft(d["r"].bitwiseAND(F.lit(_PART)), ROUND_BITS)).bitwiseOR(d["j"].cast("long")))
    return F.sort_array(F.when(n > wanted, single).otherwise(many))


def entries(ids: Column) -> Column:
    """One 32-bit entry per order, from the numbered k-mers; no k-mers give no entries."""
    n = F.size(ids)
    place = F.when(n > SKETCHES * DARTS, F.lit((1 << (PLACE_BITS + ROUND_BITS)) - 1)).otherwise(F.lit((1 << PLACE_BITS) - 1))
    looked_at = F.when(n < LOOKED_AT, F.lit(SKETCHES * DARTS * 2)).otherwise(F.lit(LOOKED_AT))
    order = lambda d: F.shiftright(d, 64 - ORDER_BITS)

    def of(d: Column) -> Column:
        begins = F.filter(F.transform(d, lambda x, j: F.when((j == 0) | (order(x) != order(F.get(d, F.greatest(j - 1, F.lit(0))))), j)), lambda j: j.isNotNull())

        def entry(m: Column) -> Column:
            # The first dart's k-mer and the first other one, in text order.
            a, b = F.get(m, F.lit(0)), F.get(F.filter(m, lambda i: i != F.get(m, F.lit(0))), F.lit(0))
            pair = let(F.struct(a.alias("a"), F.coalesce(b, a).alias("b")), lambda p: F.when(p["a"] == p["b"], F.xxhash64(F.get(ids, p["a"]))).otherwise(F.xxhash64(F.get(ids, F.least(p["a"], p["b"])), F.get(ids, F.greatest(p["a"], p["b"])))))
            return F.shiftright(pair, 32).cast("int")

        def group(begin: Column, end: Column) -> Column:
            mine = F.transform(F.slice(d, begin + 1, F.least(end - begin, looked_at)), lambda x: x.bitwiseAND(place).cast("int"))
            return F.struct(order(F.get(d, begin)).cast("int").alias("order"), let(mine, entry).alias("entry"))

        groups = let(begins, lambda f: F.transform(f, lambda j, k: group(j, F.coalesce(F.get(f, k + 1), F.size(d)))))
        by_order = lambda g, b: F.coalesce(F.get(F.filter(g, lambda x: x["order"] == b), F.lit(0))["entry"], F.lit(0))
        every = F.sequence(F.lit(-SKETCHES // 2), F.lit(SKETCHES // 2 - 1))
        return let(groups, lambda g: F.when(F.size(g) == SKETCHES, F.transform(g, lambda x: x["entry"])).otherwise(F.transform(every, lambda b: by_order(g, b))))

    return F.when(n > 0, let(darts(ids), of)).otherwise(F.array().cast("array<int>"))


def signature(text: Column) -> Column:
    """The text's ``SKETCHES`` entries as array<int>; a text without words (or null) has none."""
    hashes = F.transform(word_list(text), lambda w: F.xxhash64(w))
    return let(let(let(hashes, kmers), numbered), entries)


def shown(sig: Column) -> Column:
    """A signature as a string of eight hex digits per entry."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of entries that agree; two texts without words are alike (1), one of them is not (0)."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(same / F.lit(float(SKETCHES)))


def successors(docs: DataFrame) -> DataFrame:
    """For each distinct doc_id but in a ring: doc_id, half (code points of text that its longest row gives up), next_id, next_mark.

    Ids are dealt by range; within a range the next id follows by a window, and
    the last one gets the first id of the next range from a table of one row per
    range. Of several rows with the next id, the one with the least text hash counts.
    """
    text = F.coalesce("text", F.lit(""))
    ids = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.floor(F.char_length(text) / 2).alias("half")).groupBy("doc_id").agg(F.min("mark").alias("mark"), F.max("half").alias("half"))
    ids = materialize(ids.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()), "ids")
    following = Window.partitionBy("range").orderBy("doc_id")
    firsts = ids.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "mark")).alias("first"))
    order = Window.orderBy("range")
    around = F.first("first").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(order), around).alias("beyond"))
    here = ids.withColumn("next", F.lead(F.struct("doc_id", "mark")).over(following)).join(firsts, "range")
    pick = lambda c: F.when(F.col("next").isNotNull(), F.col(f"next.{c}")).otherwise(F.col(f"beyond.{c}"))
    return here.select("doc_id", "half", pick("doc_id").alias("next_id"), pick("mark").alias("next_mark"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's, in the order of distinct
    doc_ids (null first), the first after the last. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are
    empty. Rows with the same doc_id are each edited with the same successor; a
    lone doc_id is its own. No documents give no rows.
    """
    signed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sig", signature(F.col("text")))
    after = materialize(successors(docs), "successors")
    # Both joins below read one exchange of (doc_id, text, sig) by doc_id: the hash is no join key.
    ask = after.select(F.col("next_id").alias("_id"), F.col("next_mark").alias("_mark"), F.col("doc_id").alias("prev_id"), "half")
    met = signed.join(ask, signed["doc_id"].eqNullSafe(ask["_id"])).where(F.xxhash64("text").bitwiseXOR(F.col("_mark")) == 0)
    # Rows with the chosen hash are copies of one text: one of them is given on, however often it is repeated.
    given = met.select("prev_id", F.expr("substring(text, 1, int(half))").alias("head"), F.col("sig").alias("next_sig")).dropDuplicates(["prev_id"])
    joined = signed.join(given, signed["doc_id"].eqNullSafe(given["prev_id"]))
    n = F.char_length("text").cast("long")
    joined = joined.select("doc_id", n.alias("n_chars"), "sig", "next_sig", F.expr("concat(substring(text, 1, char_length(text) - int(floor(char_length(text) / 2))), substring(head, 1, int(floor(char_length(text) / 2))))").alias("edited"))
    joined = joined.withColumn("edited_sig", signature(F.col("edited")))
    return joined.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("sig")).alias("fingerprint"), shown(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
