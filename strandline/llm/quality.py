"""Quality rules with risk-controlled thresholds.

Signals are counted over whole texts. Which cutoffs turn a signal into a
rejection is decided on labelled rows, stratum by stratum. A quarter of them
proposes: it says which rules reject bad documents much more often than good
ones, and down to which cutoff. The proposed rules are one family with a common
level of severity; level i takes each rule's i-th cutoff. The other rows, the
holdout, certify the level: a level holds if the exact binomial
(Clopper-Pearson) upper bound of the family's rate of false rejections is within
the risk allowed. Levels are tested from the mildest on and the first failure
ends the sequence, which needs no further correction; the error level is divided
by the number of strata (Bonferroni). So all of the error is spent where labels
are, and none on single rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import let, materialize

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Good documents of a stratum that the family of certified rules may reject, as a share.
RISK = 0.02
#: Probability that any guarantee fails.
DELTA = 0.05
#: A proposed rule rejects bad documents at this many times its rate on good ones.
LIFT = 4.0
#: Bad proposing rows that a rule rejects at least to be proposed.
LEAST_BAD = 5
#: One labelled row of so many proposes, the others are the holdout.
PROPOSING = 4
#: Cutoffs of a rule.
LEVELS = 40
#: Strata up to this number are broadcast; more are joined by shuffle.
BROADCAST_STRATA = 10_000

#: Rules: name, value (larger is worse), cutoffs from the mildest to the strictest. Fixed before any data are seen.
RULES: list[tuple[str, str, list[float]]] = [
    ("symbols", "n_symbols / greatest(word_chars, 1)", [round(0.5 * 0.9**i, 6) for i in range(LEVELS)]),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", [round(0.98 - 0.02 * i, 6) for i in range(LEVELS)]),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", [round(0.3 - 0.0075 * i, 6) for i in range(LEVELS)]),
    ("short_words", "-word_chars / greatest(n_words, 1)", [round(-1.0 - 0.1 * i, 6) for i in range(LEVELS)]),
    ("long_words", "word_chars / greatest(n_words, 1)", [round(30.0 * 0.95**i, 6) for i in range(LEVELS)]),
    ("few_words", "-n_words", [-20.0 - 2 * i for i in range(LEVELS)]),
]
_ODD = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WINDOW)]


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in a window of ``WINDOW`` words that occurs at least twice."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    m = n - WINDOW + 1
    keys = ids[:m] * _ODD[0]
    for k in range(1, WINDOW):
        keys += ids[k : k + m] * _ODD[k]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[:m] += twice
    edge[WINDOW : m + WINDOW] -= twice
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() takes exactly the six blanks
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines))


def signals(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the six counts of every row's whole ``text`` (null: no words)."""
    source = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema.fields)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t) for t in batch.column(len(keep)).to_pylist()], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(rows[:, i]) for i in range(len(names)))], names=[*keep, *names])

    return source.mapInArrow(count, f"{fields}, " + ", ".join(f"{n} long" for n in names))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial: the terms from k downwards, until they no longer count."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, mode = term, n * p
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if i < mode and term < 1e-18 * total:
            break
    return min(1.0, total)


def within_risk(rejected: int, n: int, risk: float, delta: float) -> bool:
    """Whether the Clopper-Pearson upper bound at level ``delta`` (below a half) of the rejection rate is at most ``risk``."""
    return n > 0 and rejected < n * risk and binomial_cdf(rejected, n, risk) <= delta


def steps() -> Column:
    """For each rule, how many of its cutoffs reject a row; cutoff i (from 1) rejects rows of at least LEVELS - i + 1 steps."""
    def of(value: str, cutoffs: list[float]) -> Column:
        return let(F.expr(f"double({value})"), lambda v: F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: v > c)))

    return F.array(*[of(value, cutoffs) for _, value, cutoffs in RULES])


def first_level(of: Column, limits: Column) -> Column:
    """The mildest level of the family whose rules, each down to its limit, reject a row of these steps; ``LEVELS`` + 1 if none does."""
    return F.array_min(F.transform(of, lambda s, r: F.when((s > 0) & (F.get(limits, r) >= LEVELS - s + 1), LEVELS - s + 1).otherwise(F.lit(LEVELS + 1))))


def proposed_limit(bad: np.ndarray, good: np.ndarray, lift: float = LIFT) -> int:
    """The strictest cutoff (0: none) worth taking, from counts of rows by steps.

    What a cutoff rejects beyond the last one taken must hold bad rows at
    ``lift`` times the rate of good ones, ``LEAST_BAD`` of them for the first.
    """
    limit = b0 = g0 = 0
    for i in range(1, LEVELS + 1):
        b, g = int(bad[LEVELS - i + 1 :].sum()), int(good[LEVELS - i + 1 :].sum())
        if b >= LEAST_BAD and b > b0 and (b - b0) * good.sum() >= lift * (g - g0) * bad.sum():
            limit, b0, g0 = i, b, g
    return limit


def certified_level(held: np.ndarray, most: int, risk: float, level: float) -> int:
    """The last level up to ``most`` before the first that fails, from counts of good holdout rows by ``first_level``."""
    n, i = int(held.sum()), 0
    while i < most and within_risk(int(held[1 : i + 2].sum()), n, risk, level):
        i += 1
    return i


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Certified levels: stratum, limits (by rule, 0: not proposed), level (0: none certified), n_holdout and n_rejected (good holdout rows, and those the level rejects).

    ``measured`` has doc_id, the counts and ``stratum``; ``labels`` has doc_id
    and quality (1: good; null teaches nothing; of several labels of an id the
    worst counts). Every labelled row takes part. Documents that the base rules
    reject are left out: the method's verdict is not asked for them. Rows are
    counted by stratum before anything is decided; only the number of strata
    comes to the driver.
    """
    label = labels.select("doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.where(~base_failed()).select("doc_id", F.col(stratum).alias("stratum"), steps().alias("steps")).join(label, "doc_id")
    proposing = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(PROPOSING)) == 0
    rows = materialize(rows.select("stratum", (F.col("quality") == 1).alias("good"), proposing.alias("proposing"), "steps"), "labelled")
    kind = measured.schema[stratum].dataType.simpleString()
    by_rule = rows.where("proposing").select("stratum", "good", F.posexplode("steps").alias("rule", "step")).groupBy("stratum", "good", "rule", "step").agg(F.count(F.lit(1)).alias("n"))

    def propose(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros((len(RULES), 2, LEVELS + 1), np.int64)
        np.add.at(cells, (pdf["rule"], pdf["good"].astype(int), pdf["step"]), pdf["n"])
        return pd.DataFrame({"stratum": pdf["stratum"].iloc[:1], "limits": [[proposed_limit(bad, good) for bad, good in cells]]})

    limits = materialize(by_rule.groupBy("stratum").applyInPandas(propose, f"stratum {kind}, limits array<int>"), "limits")
    strata = limits.count()
    named = limits.select(F.col("stratum").alias("_stratum"), "limits")
    held = rows.where("good AND NOT proposing").groupBy("stratum", "steps").agg(F.count(F.lit(1)).alias("n"))
    held = held.join(few(named, strata), F.col("stratum").eqNullSafe(F.col("_stratum")))
    held = held.groupBy("stratum", "limits", first_level(F.col("steps"), F.col("limits")).alias("first")).agg(F.sum("n").alias("n"))

    def certify(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.bincount(pdf["first"], pdf["n"], LEVELS + 2).astype(np.int64)
        limit = pdf["limits"].iloc[0]
        level = certified_level(counts, max(limit), risk, delta / max(1, strata))
        return pd.DataFrame({"stratum": pdf["stratum"].iloc[:1], "limits": [limit], "level": [level], "n_holdout": [counts.sum()], "n_rejected": [counts[1 : level + 1].sum()]})

    found = held.groupBy("stratum").applyInPandas(certify, f"stratum {kind}, limits array<int>, level int, n_holdout long, n_rejected long")
    return materialize(found, "levels")


def few(table: DataFrame, rows: int) -> DataFrame:
    """``table`` with a broadcast hint if it has at most ``BROADCAST_STRATA`` rows."""
    return F.broadcast(table) if rows <= BROADCAST_STRATA else table


def rule_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts, base rule and verdict for every row of ``docs``.

    Needs doc_id and text, and ``stratum`` for the thresholds; ``labels`` has
    doc_id and quality. Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, n_lines, the stratum, level (the
    mildest level of severity that rejects the row, null if none does) and
    certified (the level that its stratum's holdout certified, null or 0 if
    none). A row is rejected if it fails the base rule or its level is certified.
    Null texts have no words and fail the base rule. Rows with a null doc_id are
    judged but never calibrate; repeated rows are judged alike and their label
    counts once for each; without labels, or with too few of them to certify a
    level, the base rule alone decides. Texts are counted whole.
    """
    measured = materialize(signals(docs, ["doc_id", stratum]), "signals")
    table = calibrate(measured, labels, stratum)
    levels = table.where("level > 0").select(F.col("stratum").alias("_stratum"), F.col("limits").alias("_limits"), F.col("level").alias("_certified"))
    joined = measured.join(few(levels, levels.count()), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    level = F.when(F.col("_limits").isNotNull(), first_level(steps(), F.col("_limits")))
    joined = joined.withColumn("_level", F.when(level <= LEVELS, level))
    rejected = F.coalesce(F.col("_level") <= F.col("_certified"), F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"), "n_lines", stratum, F.col("_level").alias("level"), F.col("_certified").alias("certified"),
    )
