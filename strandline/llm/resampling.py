"""Target-distribution importance resampling over hashed n-grams.

A DuckDB instance per partition unnests each text's words, windows them to
n-grams and counts the buckets of a registered zlib CRC function. The bucket
counts of every document, and one row with each partition's totals, are spilled
to Parquet through Spark's writer, so that a lost executor's part is written
anew and no file outlives a failed task. Spark merges the totals, scores the
documents by them and draws with Gumbel noise.
"""

from __future__ import annotations

import contextlib
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialize

BUCKETS = 10_000
PERCENT = 5
SEED = 42
LEAST_WORDS = 20
#: Bytes of text that DuckDB is given at once; a longer document is given alone.
SLICE_BYTES = 1 << 20
#: DuckDB's memory in a task; beyond it, it spills to the task's temporary folder.
MEMORY = "160MB"
#: Fixed value: what separates words, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"SELECT row, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS words FROM batch"
#: An n-gram's CRC goes on from that of the n-gram without its last word.
_COUNTS = f"""
WITH listed AS ({_WORDS}),
placed AS (SELECT row, unnest(words) AS a, unnest(range(len(words))) AS pos FROM listed),
followed AS (SELECT row, a, ' ' || lead(a, 1) OVER w AS b, ' ' || lead(a, 2) OVER w AS c FROM placed WINDOW w AS (PARTITION BY row ORDER BY pos)),
one AS (SELECT row, b, c, crc32(a, 0::UINTEGER) AS x FROM followed),
two AS (SELECT row, c, x, crc32(b, x) AS y FROM one),
three AS (SELECT row, x, y, crc32(c, coalesce(y, 0::UINTEGER)) AS z FROM two),
hashed AS (SELECT row, unnest([x, y, z]) % $buckets AS bucket FROM three),
counted AS (SELECT row, bucket, count(*) AS n FROM hashed WHERE bucket IS NOT NULL GROUP BY row, bucket),
lists AS (SELECT row, sum(n) AS n_features, list(bucket)::INTEGER[] AS buckets, list(n)::BIGINT[] AS counts FROM counted GROUP BY row)
SELECT coalesce(n_features, 0)::BIGINT AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts FROM batch LEFT JOIN lists USING (row) ORDER BY row
"""


def crc32(words: pa.ChunkedArray, start: pa.ChunkedArray) -> pa.Array:
    """zlib's CRC-32 of each word's UTF-8 bytes, going on from ``start``; null for a null word."""
    words, start = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (words, start))
    n, parts = len(words), words.buffers()
    at = np.frombuffer(parts[1], np.int32)[words.offset : words.offset + n + 1].tolist()
    data, crc = parts[2].to_pybytes() if parts[2] is not None else b"", zlib.crc32
    found = np.array([crc(data[i:j], s) for i, j, s in zip(at[:-1], at[1:], start.to_numpy(zero_copy_only=False).tolist(), strict=True)], np.uint32)
    return pa.array(found, pa.uint32(), mask=words.is_null().to_numpy(zero_copy_only=False) if words.null_count else None)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) of about ``SLICE_BYTES`` of text each."""
    begun, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if i > begun and held + (size or 0) > SLICE_BYTES:
            yield begun, i
            begun, held = i, 0
        held += size or 0
    if begun < len(texts):
        yield begun, len(texts)


_SUM = pa.struct([("bucket", pa.int32()), ("n", pa.int64())])


def packed(lists: pa.ListArray, kind: type) -> pa.Array:
    """Lists of numbers as the bytes of numpy's ``kind``; a count beyond it fails."""
    flat = lists.flatten().to_numpy()
    if len(flat) and flat.max() > np.iinfo(kind).max:
        raise OverflowError("a document has more features of one bucket than its counter holds")
    ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.astype(kind))])


def words_of(features: np.ndarray) -> pa.Array:
    """How many words have so many runs of one to three."""
    return pa.array(np.where(features < 2, features, features // 3 + 1), pa.int64())


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Bucket counts of every row of ``docs`` (doc_id, text): doc_id, n_words, n_features, buckets, counts, totals.

    ``buckets`` and ``counts`` are packed little-endian numbers of 2 and 4 bytes;
    buckets without a feature are left out, so a document of any length has at
    most ``buckets`` of them (65,536 at most). One further row per partition has
    the partition's sums in ``totals``, which is null in a document's row.
    """
    if buckets > 1 << 16:
        raise ValueError("a bucket is packed in two bytes")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        names = ["doc_id", "n_words", "n_features", "buckets", "counts", "totals"]
        sums, id_type = np.zeros(buckets, np.int64), None
        with tempfile.TemporaryDirectory() as spill, contextlib.closing(duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill})) as con:
            con.create_function("crc32", crc32, ["VARCHAR", "UINTEGER"], "UINTEGER", type="arrow", null_handling="special")
            for batch in batches:
                id_type = batch.schema.field(0).type
                for begun, end in slices(batch.column(1)):
                    ids, texts = batch.column(0).slice(begun, end - begun), batch.column(1).slice(begun, end - begun)
                    con.register("batch", pa.table({"row": pa.array(range(end - begun), pa.int32()), "text": texts}))
                    got = con.sql(_COUNTS, params={"buckets": buckets}).to_arrow_table().combine_chunks()
                    con.unregister("batch")
                    features, held, n = (got.column(c).chunk(0) for c in range(3))
                    np.add.at(sums, held.flatten().to_numpy(), n.flatten().to_numpy())
                    yield pa.RecordBatch.from_arrays([ids, words_of(features.to_numpy()), features, packed(held, np.uint16), packed(n, np.uint32), pa.nulls(len(ids), pa.list_(_SUM))], names=names)
            if sums.any():
                at = np.flatnonzero(sums)
                total = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["bucket", "n"]))
                made = [pa.nulls(1, id_type), pa.array([0], pa.int64()), pa.array([int(sums.sum())], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), total]
                yield pa.RecordBatch.from_arrays(made, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_words long, n_features long, buckets binary, counts binary, totals array<struct<bucket: int, n: long>>")


def merged(counts: DataFrame) -> DataFrame:
    """The partitions' totals summed: bucket, n."""
    pairs = counts.select(F.explode("totals").alias("x"))
    return pairs.groupBy("x.bucket").agg(F.sum("x.n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """What a feature of each bucket adds to a weight, by the counts (bucket, n) of all documents and of the target: bucket, gain."""
    s, t = raw.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    total = lambda counts, n: F.coalesce(counts.agg(F.sum(n)).scalar(), F.lit(0)).cast("double") + buckets
    of = lambda n: F.coalesce(n, F.lit(0)).cast("double") + 1
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    ratio = of(F.col("t")) * total(s, "s") / (of(F.col("s")) * total(t, "t"))
    return every.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def weighed(counts: DataFrame, found: DataFrame) -> DataFrame:
    """The sum of gains over each document's features: doc_id, n_words, n_features, weight.

    ``found`` has a row per bucket, a number that does not grow with the corpus;
    so its gains go to the tasks as one array.
    """
    gain = np.array([r.gain for r in found.orderBy("bucket").collect()], np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gain[np.frombuffer(b, np.uint16)] @ np.frombuffer(c, np.uint32)) for b, c in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.where("totals IS NULL").select("doc_id", "n_words", "n_features", "buckets", "counts").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A document's Gumbel noise in thousandths, by its id and ``seed`` alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rank the highest ``percent`` of the rows marked ``eligible``: the rows with ``rank`` (null if not drawn).

    Equal rows are counted first and ranked together, then written out again as
    often as they were, so no task holds the copies of one row. Groups are sorted
    over ranges of scores; only the ranges' sizes, a row each, pass through one task.
    """
    columns = scored.columns
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    groups = scored.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    groups = materialize(groups.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "groups")
    ranges = groups.groupBy("_range").agg(F.sum("_copies").alias("_n"), F.sum(F.when(F.col("eligible"), F.col("_copies"))).alias("_of"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    most = F.floor(F.coalesce(ranges.agg(F.sum("_of")).scalar(), F.lit(0)) * percent / 100)
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.withColumn("_upto", F.sum("_copies").over(within)).join(F.broadcast(offsets), "_range")
    first = F.col("_from") + F.col("_upto") - F.col("_copies")
    ranked = placed.select(*columns, F.explode(F.sequence(first + 1, first + F.col("_copies"))).alias("_rank"))
    return ranked.select(*columns, F.when(F.col("eligible") & (F.col("_rank") <= most), F.col("_rank")).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Draw ``percent`` of ``docs`` (doc_id, text) towards the n-grams of ``target`` (text): doc_id, n_words, n_features, weight, score, rank.

    Every row is returned; ``rank`` counts the drawn ones from 1 and is null for
    the others. Null, empty and wordless texts have no features, weight 0 and are
    never drawn (fewer than ``least_words`` words). A null doc_id is hashed as an
    empty string and comes after other ids of its score. Repeated rows are rows
    of their own, with ranks one after another in no particular order. Long texts
    count whole. An empty ``docs`` gives no rows; an empty ``target`` gives
    weights against a flat distribution. Other columns are ignored.
    """
    counts = materialize(bucket_counts(docs, buckets), "buckets")
    wanted = materialize(bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), buckets).where("totals IS NOT NULL"), "target")
    found = materialize(gains(merged(counts), merged(wanted), buckets), "gains")
    scored = weighed(counts, found).select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    return drawn(scored, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


#: ``resample`` of ``documents`` towards ``benchmark``; CRC-32 byte by byte over the distinct n-grams.
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crcs AS (
  SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8
), w AS (
  SELECT 'd' AS kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS ws FROM documents
  UNION ALL SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') FROM benchmark
), u AS (
  SELECT kind, doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), f AS (
  SELECT kind, doc_id, array_to_string(ws[i : i + n], ' ') AS feature, count(*) AS n FROM u, range(3) r(n) WHERE i + n <= len(ws) GROUP BY ALL
), d AS (
  SELECT DISTINCT feature FROM f
), h AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(feature)) + 1), lambda i: CAST(('0x' || substr(hex(encode(feature)), 2 * i - 1, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM d, crcs
), k AS (
  SELECT kind, doc_id, bucket, sum(n) AS n FROM f JOIN h USING (feature) GROUP BY ALL
), s AS (
  SELECT bucket, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 'b') AS t FROM k GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM s) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s
), v AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM k JOIN g USING (bucket) WHERE kind = 'd' GROUP BY doc_id
), o AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN v ON v.doc_id = w.doc_id WHERE kind = 'd'
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_words >= 20
)
SELECT o.doc_id, n_words, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM r) // 100 THEN CAST(rank AS BIGINT) END AS rank FROM o LEFT JOIN r ON r.doc_id = o.doc_id
"""
