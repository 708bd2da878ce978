"""What the training-data operators share: word rules, shared tables, distributed ranks."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a maximal run of characters that are neither space nor \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: The same rule seen from the other side, for ``split``.
BLANK = r"[\x20\x09-\x0D]+"
#: Rows of one chunk of a chunked window at least; above the square of this, a chunk has the square root of all rows.
CHUNK_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is used in local mode only; a cluster
    without the setting is an error, as its executors share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends there and any executor may be lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(written: DataFrame) -> None:
    """Delete a table that ``materialize`` returned and that nothing reads any more."""
    drop_path(written.sparkSession, written.written_at)


#: A key is hot if more than one in so many rows have it; so there are at most so many hot keys.
HOT_KEYS = 1000


def joined_spread(rows: DataFrame, table: DataFrame, keys: list[str], members: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and says in ``members`` how many rows have it.

    Hot keys are at most ``HOT_KEYS`` whatever the data, so their rows of
    ``table`` are broadcast. Rows that match them are dealt evenly over the
    other join's tasks, so that no task gathers a key that a third of all rows
    have. The keys are longs without nulls.
    """
    values = F.struct(*[c for c in table.columns if c not in keys])
    hot = table.where(F.col(members) * HOT_KEYS > table.agg(F.sum(members)).scalar())
    hot = F.broadcast(hot.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], values.alias("_hot")))
    rest = table.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], values.alias("_rest"))
    every = lambda side: reduce(and_, [F.col(k) == F.col(f"_{side}{i}") for i, k in enumerate(keys)])
    found = rows.join(hot, every("h"), "left")
    found = found.withColumn("_at", F.when(F.col("_hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*rows.columns)))
    same = reduce(and_, [F.col(k) == F.col(f"_t{i}") for i, k in enumerate(keys) if i], F.col("_at") == F.col("_t0"))
    found = found.join(rest, same & F.col("_hot").isNull(), "left").withColumn("_met", F.coalesce("_hot", "_rest"))
    return found.where(F.col("_met").isNotNull()).select(*rows.columns, "_met.*")


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The hot keys of ``rows`` (_key) and over how many copies each is to be dealt: at most 2 * ``HOT_KEYS`` in all."""
    counted = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") * HOT_KEYS / rows.agg(F.count(F.lit(1))).scalar()
    return counted.where(share > 1).select("_key", F.ceil(share).cast("int").alias("_copies"))


def joined_salted(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per key) where a key may hold a third of ``rows`` and a row of ``table`` may be large.

    The rows of a hot key are dealt over copies of its row of ``table``. Copies
    are as many as the key's share asks for, so they are few in all.
    """
    hot = F.broadcast(hot_keys(rows, key))
    values = [c for c in table.columns if c != key]
    left = rows.join(hot, F.col(key) == F.col("_key"), "left")
    left = left.select(*rows.columns, F.when(F.col("_copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_copies"))).cast("int").alias("_salt"))
    right = table.join(hot, F.col(key) == F.col("_key"), "left")
    right = right.select(F.col(key).alias("_right"), *values, F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)).alias("_copy"))
    return left.join(right, (F.col(key) == F.col("_right")) & (F.col("_salt") == F.col("_copy"))).select(*rows.columns, *values)


def rewritten(docs: DataFrame, row: Column, text: Column) -> list[Column]:
    """The columns of ``docs`` out of a struct ``row``, with ``text`` as text and its length as ``n_chars`` (if there)."""
    def one(c: str) -> Column:
        return text if c == "text" else F.length(text).cast(docs.schema[c].dataType) if c == "n_chars" else row.getField(c)

    return [one(c).alias(c) for c in docs.columns]


def word_list(text: Column) -> Column:
    """The words of a text in order; null or blank text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has, as long; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(*cols: Column) -> Column:
    """A pseudo-random double in [0, 1) that depends on ``cols`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def ranked(df: DataFrame, key: list[str], spread: Column, order: list, chunks: int, name: str = "rank") -> DataFrame:
    """Number the rows of each ``key`` from 0 without putting a key into one task.

    ``spread`` deals a key's rows to ``chunks`` chunks; within a chunk ``order``
    decides. Chunk sizes are summed to offsets over a table of one row per
    (key, chunk), so a key that holds a third of all rows is ranked by many tasks.
    """
    df = df.withColumn("_chunk", F.pmod(spread, F.lit(chunks)).cast("int"))
    sizes = df.groupBy(*key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy(*key, "_chunk").orderBy(*order)
    df = df.withColumn("_row", F.row_number().over(within) - 1)
    return df.join(offsets, [*key, "_chunk"]).withColumn(name, F.col("_from") + F.col("_row")).drop("_chunk", "_row", "_from")


def chunks_for(rows: int) -> int:
    """How many chunks leave few rows in a chunk and few chunks in a key."""
    return max(1, -(-rows // max(CHUNK_ROWS, math.isqrt(rows))))
