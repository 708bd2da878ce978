"""Spelling variants: words one edit apart by forward and reversed dictionaries.

One edit leaves the first or the second half of the shorter word intact, so two
words that are near stand in one block of the dictionary sorted by first halves
or of the one sorted by reversed second halves. A block that holds too many
words is divided by the same rule: the part of its words where the edit must lie
is halved again, and the half that stays intact joins the block's key. At the
end that part is a character, so every block gets small, and nothing is cut.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import drop_table, materialize

LEAST_CHARS = 7
LEAST_COUNT = 2
DAMAGE = 31
TIMES = 10
#: A block of more words than this is divided.
BLOCK = 48
#: Words that a task's counter holds before it passes them on.
HELD = 300_000

#: Latin-1 bytes: A-Z become a-z, letters stay, anything else becomes a space. Characters beyond Latin-1 become "?" before.
_LETTERS = bytes(ord(chr(i).lower()) if chr(i) in string.ascii_uppercase else i if chr(i) in string.ascii_lowercase or i >= 0xC0 else 32 for i in range(256))


def word_counts(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """Count the letter runs of every text, some with a letter deleted by the hash of id and run: word, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter((text.as_py() or "").encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
                    if h % damage == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    found[run] += n
                if len(found) > HELD:
                    yield passed()
        yield passed()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def entries(rows: DataFrame) -> DataFrame:
    """Rows (kind, longer, m, first, last, word) with the hash of their block."""
    ends = F.xxhash64("kind", "m", "first", "last", F.expr("substring(word, 1, first)"), F.expr("right(word, last)"))
    return rows.withColumn("block", ends)


def halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first, and with the second half of the part between its intact ends intact as well.

    A replaced letter leaves a half of the other letters intact, an inserted one
    a half of all letters of the shorter word.
    """
    between = F.col("m") - F.col("first") - F.col("last")
    half = F.when(F.col("kind") == "replaced", F.floor(between / 2)).otherwise(F.ceil(between / 2)).cast("int")
    rows = rows.withColumn("_half", half)
    side = F.explode(F.array(F.struct((F.col("first") + F.col("_half")).alias("first"), F.col("last").alias("last")), F.struct(F.col("first").alias("first"), (F.col("last") + F.col("_half")).alias("last"))))
    return rows.select("kind", "longer", "m", "word", side.alias("_ends")).select("kind", "longer", "m", "_ends.first", "_ends.last", "word")


def near_pairs(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """All pairs of different ``words`` (word, distinct) that one inserted, deleted or replaced code point parts: a, b.

    Words are sorted into blocks of intact ends; blocks of more than ``most``
    words are divided until their words differ in a single place, so a block
    holds few words whatever the dictionary, and pairs are formed in blocks only.
    """
    n = F.length("word")
    whole = F.lit(0).alias("first"), F.lit(0).alias("last"), F.col("word")
    replaced = words.select(F.lit("replaced").alias("kind"), F.lit(False).alias("longer"), n.alias("m"), *whole)
    shorter = words.select(F.lit("inserted").alias("kind"), F.lit(False).alias("longer"), n.alias("m"), *whole)
    longer = words.select(F.lit("inserted").alias("kind"), F.lit(True).alias("longer"), (n - 1).alias("m"), *whole)
    open_rows, done = entries(halved(replaced.unionByName(shorter).unionByName(longer))), None
    while True:
        open_rows = materialize(open_rows, "blocks")
        # A block of one kind of row, or whose words can differ in one place only, is done.
        sizes = open_rows.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("m") - F.col("first") - F.col("last")).alias("between"), F.max("kind").alias("of"))
        wide = sizes.where((F.col("size") > most) & (F.col("between") > F.when(F.col("of") == "replaced", 1).otherwise(0))).select("block")
        parted = open_rows.join(wide.withColumn("wide", F.lit(True)), "block", "left")
        kept = parted.where("wide IS NULL").select("block", "kind", "longer", "word")
        done = kept if done is None else done.unionByName(kept)
        if wide.isEmpty():
            break
        open_rows = entries(halved(parted.where("wide").drop("block", "wide")))
    done = materialize(done, "blocks")
    left = done.where("NOT longer").select("block", "kind", F.col("word").alias("a"))
    right = done.select(F.col("block").alias("_block"), "longer", F.col("word").alias("b"))
    same = (F.col("block") == F.col("_block")) & ((F.col("kind") == "inserted") & F.col("longer") | (F.col("kind") == "replaced") & (F.col("a") < F.col("b")))
    return left.join(right, same & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """Follow ``forms`` (word, form) to the last word by pointer jumping: word, root. A form has more occurrences than its word, so no walk returns."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_table(steps)
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        steps = step.drop("moved")
        steps.written_at = step.written_at


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES, damage: int = DAMAGE) -> DataFrame:
    """Group the words of ``docs`` (doc_id, text) with the spelling they are a rare variant of: word, form, root, n, n_near, form_n.

    A word's form is its near word with most occurrences (of equal ones the
    smallest in code-point order) if it has at least ``times`` as many, else
    null; its root is where the forms lead. Null and empty texts and an empty
    table have no words; a null doc_id counts as an empty string in the hash;
    repeated rows count as often as they are there; runs and texts of any length
    count whole. Other columns are ignored.
    """
    counted = word_counts(docs, damage)
    words = materialize(counted.where((F.length("word") >= least_chars) & (F.col("n") >= least_count)), "words")
    pairs = near_pairs(words.select("word"))
    pairs = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near")
    other = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = pairs.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    is_form = -F.col("best.m") >= times * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.b")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"))
    found = materialize(found, "forms")
    last = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: ``variants`` of ``documents``; CRC-32 byte by byte, near words by the strings that a deletion leaves.
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crcs AS (
  SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-zÀ-ÿ]+')) AS run FROM documents
), d AS (
  SELECT doc_id, run, count(*) AS n, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS bytes FROM r GROUP BY doc_id, run
), h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(bytes) + 1), lambda i: CAST(('0x' || substr(hex(bytes), 2 * i - 1, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) AS h FROM d, crcs
), w AS (
  SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING len(word) >= {LEAST_CHARS} AND sum(n) >= {LEAST_COUNT}
), v AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word, b.word AS near, b.n AS m FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON w.word = v.rest
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON w.word = v.rest
), b AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM p GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * w.n THEN near END AS form, CASE WHEN m >= {TIMES} * w.n THEN m END AS form_n FROM w LEFT JOIN b ON b.word = w.word
), s AS (
  SELECT word, word AS root, form AS next FROM f UNION ALL SELECT s.word, s.next, f.form FROM s JOIN f ON f.word = s.next
)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word AND s.next IS NULL
"""
