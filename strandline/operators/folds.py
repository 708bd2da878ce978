"""Aggregations with the reference's rules: folds, counts, quantiles, capped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.shared import written


def furthest_wins(df: DataFrame, key: list[str], rank: str, pos: str) -> DataFrame:
    """The row of the greatest rank per key, the first position on ties."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(F.col(rank), -F.col(pos))).alias("r")).select(*key, "r.*")


def first_known(df: DataFrame, key: list[str], columns: list[str], pos: str) -> DataFrame:
    """Per key and column the first value that is known, in the order of ``pos``."""
    return df.groupBy(*key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(c) for c in columns])


def unique_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; map-side combine, no sort of whole groups."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(*key, "r.*")


def shares_that_partition(df: DataFrame, key: list[str], classes: dict[str, Column]) -> DataFrame:
    """Conditional counts of classes and a rest that together make the total."""
    known = F.lit(False)
    for c in classes.values():
        known = known | F.coalesce(c, F.lit(False))
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in classes.items()], F.count_if(~known).alias("rest"))


def quantile_floor(values: Column, q: float) -> Column:
    """sorted[floor(q * n)] of an array, the last element at most."""
    s = F.array_sort(values)
    return F.element_at(s, (F.least(F.floor(F.size(s) * q), F.size(s) - 1) + 1).cast("int"))


def quantile_rounded(values: Column, q: float) -> Column:
    """sorted[round((n - 1) * q)] of an array."""
    s = F.array_sort(values)
    return F.element_at(s, (F.floor((F.size(s) - 1) * q + 0.5) + 1).cast("int"))


def ranks_of(df: DataFrame, key: list[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """Exact order statistics per key without collecting a group: values are counted, ranks are running sums.

    ``picks`` names 0-based ranks as expressions of ``n``, the group's size. The
    window runs over distinct values, so a hot key costs its distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_c"))
    by_value = Window.partitionBy(*key).orderBy(value)
    summed = counted.withColumn("_upto", F.sum("_c").over(by_value.rowsBetween(Window.unboundedPreceding, 0)))
    summed = summed.withColumn("n", F.sum("_c").over(Window.partitionBy(*key)))
    hit = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    return summed.groupBy(*key).agg(F.first("n").alias("n"), *[hit(rank).alias(name) for name, rank in picks.items()])


def floor_rank(q: float) -> Column:
    return F.least(F.floor(F.col("n") * q), F.col("n") - 1)


def rounded_rank(q: float) -> Column:
    return F.floor((F.col("n") - 1) * q + 0.5)


def ceil_rank(q: float) -> Column:
    return F.greatest(F.ceil(F.col("n") * q) - 1, F.lit(0))


def capped_counts(df: DataFrame, group: list[str], host: str, most: int, other: str = "andere") -> DataFrame:
    """Counts per group and host; hosts beyond the ``most`` largest (then by name) are summed under ``other``."""
    counted = df.groupBy(*group, host).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), host))
    named = counted.withColumn(host, F.when(rank <= most, F.col(host)).otherwise(F.lit(other)))
    return named.groupBy(*group, host).agg(F.sum("n").alias("n"))


def with_spine(daily: DataFrame, day: str, value: str) -> DataFrame:
    """Every day from the first to the last one; days without a row have 0. The first stored day is dropped, as it may be partial."""
    span = daily.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = span.where(F.col("a") < F.col("b")).select(F.explode(F.sequence(F.date_add("a", 1), F.col("b"))).alias(day))
    return days.join(daily, day, "left").select(day, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def merge_groups(df: DataFrame, name: str, size: str, key: Column) -> DataFrame:
    """Exact-name groups with equal normal keys become one, under the name of the largest (then smallest name)."""
    keyed = df.withColumn("_k", key)
    merged = keyed.groupBy("_k").agg(F.max_by(F.col(name), F.struct(F.col(size))).alias("_any"), F.sum(size).alias(f"{size}_sum"), F.max(size).alias("_top"))
    lead = keyed.join(merged, "_k").where(F.col(size) == F.col("_top")).groupBy("_k").agg(F.min(name).alias(name))
    return lead.join(merged, "_k").select(name, F.col(f"{size}_sum").alias(size))


def name_key(name: Column) -> Column:
    """Lower case, umlauts folded, everything but letters and digits to single spaces."""
    folded = F.lower(name)
    for letter, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def merge_near_groups(df: DataFrame, name: str, size: str, least_key: int = 25, least_word: int = 13) -> DataFrame:
    """Groups (name, size) whose keys are equal or one typed letter apart become one, under the name of the largest (then the first key).

    One letter is a slip only in keys of ``least_key`` characters and inside a word
    of ``least_word``; digits never are. Keys emit their variants with a character
    less, and equal variants meet: no pair of groups is compared that does not.
    """
    whole = df.groupBy(name_key(F.col(name)).alias("key")).agg(F.max_by(name, F.struct(size)).alias("name"), F.sum(size).alias("n"))
    at = F.explode(F.sequence(F.lit(1), F.length("key"))).alias("i")
    word = F.length(F.regexp_extract(F.expr("left(key, i)"), "[^ ]*$", 0)) + F.length(F.regexp_extract(F.expr("substring(key, i + 1)"), "^[^ ]*", 0))
    slips = whole.where(F.length("key") >= least_key).select("key", at).where(F.expr("substring(key, i, 1)").rlike(r"\p{L}") & (word >= least_word))
    cut = slips.select("key", "i", F.expr("concat(left(key, i - 1), substring(key, i + 1))").alias("v"))
    swapped = cut.join(cut.select(F.col("key").alias("other"), "i", "v"), ["i", "v"]).where("key <> other").select("key", "other")
    shorter = cut.join(whole.select(F.col("key").alias("v"), F.col("key").alias("other")), "v").select("key", "other")
    pairs = swapped.unionByName(shorter).unionByName(shorter.select(F.col("other").alias("key"), F.col("key").alias("other"))).distinct()
    rank = whole.select(F.col("key").alias("other"), F.col("n").alias("m"))
    best = pairs.join(rank, "other").groupBy("key").agg(F.max(F.struct("m", "other")).alias("near"))
    joined = whole.join(best, "key", "left")
    larger = (F.col("near.m") > F.col("n")) | ((F.col("near.m") == F.col("n")) & (F.col("near.other") < F.col("key")))
    led = written(joined.select(F.when(larger, F.col("near.other")).otherwise(F.col("key")).alias("lead"), "key", "name", "n"), "leads")
    # A lead may follow a larger one in turn: pointers are doubled until none moves.
    while True:
        above = led.select(F.col("key").alias("lead"), F.col("lead").alias("top"))
        moved = written(led.join(above, "lead"), "leads")
        led = moved.select(F.col("top").alias("lead"), "key", "name", "n")
        if moved.where("top <> lead").isEmpty():
            break
    return led.groupBy("lead").agg(F.max_by("name", F.col("key") == F.col("lead")).alias(name), F.sum("n").alias(size)).select(name, size)


def usage_summary(counts: DataFrame, day: str, group: str, value: str, other: str, least: int, most: int) -> DataFrame:
    """The ``most`` groups of at least ``least`` over all days but the first stored one, by count and then name; ``other`` is a bucket and not ranked."""
    first = counts.agg(F.min(day)).scalar()
    totals = counts.where((F.col(day) > first) & (F.col(group) != other)).groupBy(group).agg(F.sum(value).alias(value)).where(F.col(value) >= least)
    top = totals.orderBy(F.desc(value), group).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), group)))
