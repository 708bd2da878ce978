"""Longest increasing chains in arrays, with ties refused."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


def certain(values: list[int]) -> list[int]:
    """Positions (from 0) that every longest strictly increasing subsequence of ``values`` has.

    Patience sorting from both ends gives the longest chain that ends, and that
    begins at each value; a value is certain if both make up a longest chain and
    no other value could stand at its place in one.
    """

    def lengths(seq: list[int]) -> list[int]:
        tops: list[int] = []
        out = []
        for v in seq:
            at = bisect_left(tops, v)
            tops[at : at + 1] = [v]
            out.append(at + 1)
        return out

    ends, begins = lengths(values), lengths([-v for v in reversed(values)])[::-1]
    most = max(ends, default=0)
    able = [i for i in range(len(values)) if ends[i] + begins[i] - 1 == most]
    at_place = Counter(ends[i] for i in able)
    return [i for i in able if at_place[ends[i]] == 1]


def certain_positions(values: Column) -> Column:
    """``certain`` of an array of longs without nulls, as an array; null stays null."""

    @F.pandas_udf(ArrayType(LongType()))
    def of(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else certain([int(x) for x in a]))

    return of(values)


def on_chain(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """The rows of ``pairs`` (key, a, b) that every longest chain rising in both a and b has.

    A key's pairs stand in one array, so a key is a document's units, no more.
    Of pairs with the same ``a``, none can follow the other.
    """
    listed = pairs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(a).alias("a"), (-F.col(b)).alias("b")))).alias("_l"))
    chosen = listed.withColumn("_at", certain_positions(F.transform("_l", lambda x: -x["b"])))
    kept = chosen.select(*key, F.explode(F.transform("_at", lambda i: F.get("_l", i.cast("int")))).alias("_x"))
    return kept.select(*key, F.col("_x.a").alias(a), (-F.col("_x.b")).alias(b))


def shifts(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """The renumbering that certain pairs tell: runs of one shift b - a, as key, first, last (of a), shift, pairs.

    Islands of equal shifts in the order of ``a`` on the longest chain; pairs off it are moves, not renumberings.
    """
    chain = on_chain(pairs, key, a, b).withColumn("shift", F.col(b) - F.col(a))
    w = Window.partitionBy(*key).orderBy(a)
    begun = chain.withColumn("_new", F.coalesce((F.lag("shift").over(w) != F.col("shift")).cast("int"), F.lit(1)))
    numbered = begun.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "_run", "shift").agg(F.min(a).alias("first"), F.max(a).alias("last"), F.count(F.lit(1)).alias("pairs")).drop("_run")
