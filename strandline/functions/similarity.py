"""Similarity measures of token arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _soft_count(a: Column, b: Column) -> Column:
    """Tokens of ``a`` that equal one of ``b``, or share a prefix relation of at least eight characters with one."""
    soft = lambda x, y: (x == y) | ((F.length(x) >= 8) & (F.length(y) >= 8) & (x.startswith(y) | y.startswith(x)))
    return F.size(F.filter(a, lambda x: F.exists(b, lambda y: soft(x, y))))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings."""
    letters = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    differs = F.array_position(F.zip_with(letters(a), letters(b), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(a.isNull() | b.isNull(), 0).when(differs > 0, differs - 1).otherwise(F.length(a)).cast("int")


def title_components(a: Column, b: Column) -> Column:
    """Struct (jac, cont, cov, lcp) of two token arrays, each rounded to three digits; an empty side gives zeros."""
    forth, back = _soft_count(a, b), _soft_count(b, a)
    m = F.least(forth, back)
    sa, sb = F.array_join(a, " "), F.array_join(b, " ")
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    part = lambda x, y: F.when(empty, 0.0).otherwise(F.round(x / F.greatest(y, F.lit(1)), 3))
    return F.struct(
        part(m, F.size(a) + F.size(b) - m).alias("jac"),
        part(m, F.least(F.size(a), F.size(b))).alias("cont"),
        part(forth, F.size(a)).alias("cov"),
        part(common_prefix(sa, sb), F.least(F.length(sa), F.length(sb))).alias("lcp"),
    )


def title_score(c: Column, a: Column, b: Column) -> Column:
    """One score from the components of two token arrays, as the linking rule weighs them; a one-word title within a longer one says less."""
    full = F.when(F.least(F.size(a), F.size(b)) >= 2, 0.9 + 0.1 * F.greatest(c["jac"], c["lcp"])).otherwise(F.greatest(F.lit(0.6), c["jac"], c["lcp"]))
    return F.when(c["cont"] >= 0.99, full).otherwise(F.greatest(0.8 * c["cont"], c["jac"], 0.9 * c["lcp"], 0.9 * c["cov"]))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; two empty sets give 0."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Share of the distinct elements of ``a`` that ``b`` has; null for an empty ``a``."""
    n = F.size(F.array_distinct(a))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n)


def coverage(want: Column, have: Column) -> Column:
    """Share of the bag ``want`` found in the set ``have``; null for an empty bag."""
    return F.when(F.size(want) > 0, F.size(F.filter(want, lambda w: F.array_contains(have, w))) / F.size(want))
