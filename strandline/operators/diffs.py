"""Text comparison: word differences, unit alignment, change classes.

The longest common subsequence needs a dynamic programme per pair, so it runs in
Arrow-batched Python, a table row at a time in numpy; all counting and classing
around it is native.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SEGMENTS = "array<struct<type: string, text: string>>"
DIFF = f"struct<similarity: double, segments: {SEGMENTS}>"
#: How many rows of arrays become Python objects at a time.
ROWS = 128


def bag_similarity(a: list[str], b: list[str]) -> float:
    """2 * sum of the lesser counts / all words; two empty texts are alike."""
    n = len(a) + len(b)
    return 2 * sum((Counter(a) & Counter(b)).values()) / n if n else 1.0


def row_above(below: np.ndarray, same: np.ndarray) -> np.ndarray:
    """One row of the table of longest common subsequences of suffixes, from the row below and where this row's word occurs.

    A row never rises to the right, so the recurrence is a running maximum from the right end: numpy takes a row at once.
    """
    candidates = below.copy()
    candidates[:-1] = np.where(same, below[1:] + 1, below[:-1])
    return np.maximum.accumulate(candidates[::-1])[::-1]


def common_path(x: np.ndarray, y: np.ndarray) -> tuple[int, list[str]]:
    """Length of the longest common subsequence and the steps (equal, removed, inserted) of the path that removes before it inserts on ties.

    Every square root of the rows is kept; the rows between are computed again
    when the path comes through them, so memory is in proportion to a row times that root.
    """
    n, m = len(x), len(y)
    stretch = max(1, math.isqrt(n))
    kept = {n: np.zeros(m + 1, np.int32)}
    row = kept[n]
    for i in range(n - 1, -1, -1):
        row = row_above(row, y == x[i])
        if i % stretch == 0:
            kept[i] = row
    steps: list[str] = []
    i = j = 0
    for begin in range(0, n, stretch):
        end = min(n, begin + stretch)
        rows = {end: kept[end]}
        for k in range(end - 1, begin - 1, -1):
            rows[k] = row_above(rows[k + 1], y == x[k])
        while i < end:
            if j < m and x[i] == y[j]:
                steps.append("equal")
                i, j = i + 1, j + 1
            elif j == m or rows[i + 1][j] >= rows[i][j + 1]:
                steps.append("removed")
                i += 1
            else:
                steps.append("inserted")
                j += 1
    return int(kept[0][0]), steps + ["inserted"] * (m - j)


def word_diff(a: list[str], b: list[str], most: int | None = None) -> tuple[float, list[tuple[str, str]] | None]:
    """Similarity 2 * LCS / all words and the segments (equal, removed, inserted); on ties words are removed before others are inserted.

    With ``most``, a comparison of more cells (words that differ on one side times
    those on the other) gets the similarity of the bags and no segments; without
    it every pair is compared exactly.
    """
    if not a and not b:
        return 1.0, []
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if most is not None and len(x) * len(y) > most:
        return bag_similarity(a, b), None
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in side], np.int32) for side in (x, y)]
    same, steps = common_path(*ids)
    pieces: list[tuple[str, list[str]]] = [("equal", a[:head])]
    i = j = 0
    for kind in steps:
        if pieces[-1][0] != kind:
            pieces.append((kind, []))
        pieces[-1][1].append(y[j] if kind == "inserted" else x[i])
        i, j = i + (kind != "inserted"), j + (kind != "removed")
    if pieces[-1][0] != "equal":
        pieces.append(("equal", []))
    pieces[-1][1].extend(a[len(a) - tail :] if tail else [])
    return 2 * (head + tail + same) / (len(a) + len(b)), [(kind, " ".join(words)) for kind, words in pieces if words]


def word_diffs(old: Column, new: Column) -> Column:
    """Struct (similarity, segments) of two text columns; null texts are empty."""

    @F.pandas_udf(DIFF)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [word_diff((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"similarity": [s for s, _ in found], "segments": [None if p is None else [{"type": k, "text": t} for k, t in p] for _, p in found]})

    return run(old, new)


def change_class(diff: Column) -> Column:
    """unchanged, editorial (only punctuation or case), renumbered (only numbers) or changed."""
    changed = F.filter(diff["segments"], lambda s: s["type"] != "equal")
    words = F.concat_ws(" ", F.transform(changed, lambda s: s["text"]))
    side = lambda kind: F.lower(F.regexp_replace(F.concat_ws(" ", F.transform(F.filter(changed, lambda s: s["type"] == kind), lambda s: s["text"])), r"[^\p{L}\p{N}]", ""))
    return F.when(diff["segments"].isNull(), "changed").when(F.size(changed) == 0, "unchanged").when(side("removed") == side("inserted"), "editorial").when(words.rlike(r"^[\d\s.,()§]*$"), "renumbered").otherwise("changed")


def counts_of(segments: Column) -> Column:
    """Struct of words equal, removed and inserted."""
    n = lambda kind: F.aggregate(F.filter(segments, lambda s: s["type"] == kind), F.lit(0), lambda a, s: a + F.size(F.split(s["text"], " ")))
    return F.struct(n("equal").alias("equal"), n("removed").alias("removed"), n("inserted").alias("inserted"))


def similar_units(old: list[Counter], new: list[Counter], least: float) -> list[tuple[float, int, int]]:
    """(similarity, i, j) of all bags of words with 2 * common / all at ``least`` or more.

    Pairs meet under one of their first words, rarest first: of n words at least
    ``least`` * n / (2 - ``least``) are common, so the others are few enough to skip.
    """
    spread = Counter(w for bag in old + new for w in bag)

    def first(bag: Counter) -> list[str]:
        words = sorted(bag.elements(), key=lambda w: (spread[w], w))
        return sorted(set(words[: len(words) - math.ceil(least * len(words) / (2 - least) - 1e-9) + 1]))

    under: dict[str, list[int]] = {}
    for j, bag in enumerate(new):
        for w in first(bag):
            under.setdefault(w, []).append(j)
    sizes = [bag.total() for bag in new]
    out = []
    for i, bag in enumerate(old):
        n = bag.total()
        for j in {j for w in first(bag) for j in under.get(w, ())}:
            if 2 * min(n, sizes[j]) >= least * (n + sizes[j]):
                score = 2 * (bag & new[j]).total() / (n + sizes[j])
                if score >= least:
                    out.append((score, i, j))
    return out


def align(old: list[dict], new: list[dict], same_id: float = 0.5, greedy: float = 0.6) -> list[tuple[int | None, int | None]]:
    """Pairs of positions of units (heading, id, text): unique headings, then equal ids that are similar, then the most similar first.

    Order: that of the later text; what was removed stands before the next pair it preceded.
    """
    pairs: dict[int, int] = {}
    free_old, free_new = set(range(len(old))), set(range(len(new)))
    words = lambda u: (u["text"] or "").split()

    def take(i: int, j: int) -> None:
        pairs[i] = j
        free_old.discard(i)
        free_new.discard(j)

    def unique(units: list[dict], free: set[int], key: str) -> dict[str, int]:
        seen: dict[str, list[int]] = {}
        for i in sorted(free):
            if units[i].get(key):
                seen.setdefault(units[i][key], []).append(i)
        return {k: v[0] for k, v in seen.items() if len(v) == 1}

    there = unique(new, free_new, "heading")
    for key, i in unique(old, free_old, "heading").items():
        if key in there:
            take(i, there[key])
    there = unique(new, free_new, "id")
    for key, i in unique(old, free_old, "id").items():
        if key in there and not (old[i].get("heading") and new[there[key]].get("heading")) and bag_similarity(words(old[i]), words(new[there[key]])) >= same_id:
            take(i, there[key])
    left, right = [i for i in sorted(free_old) if words(old[i])], [j for j in sorted(free_new) if words(new[j])]
    scored = similar_units([Counter(words(old[i])) for i in left], [Counter(words(new[j])) for j in right], greedy)
    for _, i, j in sorted((-score, left[i], right[j]) for score, i, j in scored):
        if i in free_old and j in free_new:
            take(i, j)
    back = {j: i for i, j in pairs.items()}
    out: list[tuple[int | None, int | None]] = []
    flushed: set[int] = set()
    for j in range(len(new)):
        if j in back:
            for i in sorted(free_old - flushed):
                if i < back[j]:
                    out.append((i, None))
                    flushed.add(i)
        out.append((back.get(j), j))
    return out + [(i, None) for i in sorted(free_old - flushed)]


def aligned_units(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Units (key..., pos, heading, id, text) of two versions aligned per key: line, old_pos, new_pos, kind, old_text, new_text."""
    schema = StructType([old.schema[k] for k in key] + [StructField(c, LongType()) for c in ("line", "old_pos", "new_pos")] + [StructField(c, StringType()) for c in ("kind", "old_text", "new_text")])
    types = [pa.int64()] * 3 + [pa.string()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                some = batch.slice(first, ROWS)
                at, rows = [], []
                for row, (x, y) in enumerate(zip(some.column("_olds").to_pylist(), some.column("_news").to_pylist(), strict=True)):
                    for line, (i, j) in enumerate(align(x, y)):
                        before, after = x[i]["text"] if i is not None else None, y[j]["text"] if j is not None else None
                        kind = "inserted" if i is None else "removed" if j is None else "unchanged" if before == after else "changed"
                        at.append(row)
                        rows.append((line, x[i]["pos"] if i is not None else None, y[j]["pos"] if j is not None else None, kind, before, after))
                told = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([some.column(k).take(pa.array(at, pa.int64())) for k in key] + told, names=schema.names)

    # A key's two versions are a row of arrays, and many rows are handed over at a time; frames for each key cost more than its alignment.
    unit, none = F.struct("pos", "heading", "id", "text"), F.lit(None)
    both = old.select(*key, unit.alias("_old"), none.alias("_new")).unionByName(new.select(*key, none.alias("_old"), unit.alias("_new")))
    listed = both.groupBy(*key).agg(*[F.array_sort(F.collect_list(c)).alias(f"{c}s") for c in ("_old", "_new")])
    return listed.mapInArrow(run, schema)


#: The pairing rules in order: each pairs what is unique on both sides and still free.
PAIRING = ["only", "similar title", "same name", "short title", "contained", "number", "address", "base"]


def pair_articles(old: list[dict], new: list[dict], similar: float = 0.5, contained: float = 0.8) -> list[tuple[int, int, str]]:
    """Articles (title, name, short, number, address, base) of two packages paired by rules in sequence: (old, new, rule)."""
    out: list[tuple[int, int, str]] = []
    left, right = set(range(len(old))), set(range(len(new)))
    words = lambda u: set((u.get("title") or "").lower().split())

    def take(i: int, j: int, rule: str) -> None:
        out.append((i, j, rule))
        left.discard(i)
        right.discard(j)

    def by_key(rule: str, key) -> None:
        sides = []
        for units, free in ((old, left), (new, right)):
            seen: dict = {}
            for i in free:
                value = key(units[i])
                if value:
                    seen.setdefault(value, []).append(i)
            sides.append({k: v[0] for k, v in seen.items() if len(v) == 1})
        for value in sorted(sides[0].keys() & sides[1].keys(), key=str):
            take(sides[0][value], sides[1][value], rule)

    def by_score(rule: str, score, least: float) -> None:
        scored = sorted((-score(words(old[i]), words(new[j])), i, j) for i in left for j in right if words(old[i]) and words(new[j]))
        for minus, i, j in scored:
            rivals = [s for s, a, b in scored if (a == i) != (b == j) and s == minus and a in left and b in right]
            if -minus >= least and i in left and j in right and not rivals:
                take(i, j, rule)

    if len(old) == 1 and len(new) == 1:
        return [(0, 0, "only")]
    by_score("similar title", lambda a, b: len(a & b) / len(a | b), similar)
    by_key("same name", lambda u: u.get("name"))
    by_key("short title", lambda u: u.get("short"))
    by_score("contained", lambda a, b: len(a & b) / min(len(a), len(b)), contained)
    by_key("number", lambda u: u.get("number"))
    by_key("address", lambda u: u.get("address"))
    by_key("base", lambda u: u.get("base"))
    return sorted(out)


def paired_articles(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Articles (key, pos and the columns ``pair_articles`` reads) of two packages paired per key: key, old_pos, new_pos, rule.

    A package's articles are one law's: a group is as small as that.
    """
    kind = old.schema[key].dataType.simpleString()

    def run(group: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (d.sort_values("pos").to_dict("records") if len(d) else [] for d in (a, b))
        rows = [(group[0], x[i]["pos"], y[j]["pos"], rule) for i, j, rule in pair_articles(x, y)]
        return pd.DataFrame(rows, columns=[key, "old_pos", "new_pos", "rule"])

    new = new.select(*[F.col(c).alias(c) for c in new.columns])
    return old.groupBy(key).cogroup(new.groupBy(key)).applyInPandas(run, f"{key} {kind}, old_pos long, new_pos long, rule string")
