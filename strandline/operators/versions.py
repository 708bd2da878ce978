"""Units of two and three versions of a text: pairing in passes, renumberings, and scoping by composed pairs.

Units are rows (key..., pos, part, id, address, cited, words): the place in the
text, the law of the package, the number, the place that an instruction edits
(null where it names none), the sorted designations that it cites, and the words
that are compared. Every pass pairs only what stands alone on both sides among the
units that are still free. The units of a key travel as one row of arrays, so
their texts are never sorted; many rows are handed to Python at a time.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from strandline.operators.diffs import ROWS, similar_units
from strandline.sources.shared import written

#: Likeness that a pair of equal numbers, of an equal place, and of a readdressed instruction needs.
SAME_ID = 0.5
SAME_PLACE = 0.4
SAME_PLACE_CONTAINED = 0.8
READDRESSED = 0.8


def _said(units: DataFrame) -> Column:
    return F.array_join("words", " ")


def _listed(said: Column) -> Column:
    """The words of a text made by ``_said``."""
    return F.when(said == "", F.array().cast("array<string>")).otherwise(F.split(said, " "))


def likeness(rows: DataFrame, where: Column, a: str, b: str) -> DataFrame:
    """``rows`` with ``_alike`` (2 * common words / all) and ``_contained`` (common words / the fewer) of the texts ``a`` and ``b``, words counted as often as they stand; null unless ``where``."""
    # A word's repetitions are numbered, so that common ones count in common.
    numbered = lambda c: F.transform(c, lambda w, i: F.concat(w, F.lit(" "), (i - F.array_position(c, w)).cast("string")))
    rows = rows.withColumns({"_x": F.when(where, F.sort_array(_listed(F.col(a)))), "_y": F.when(where, F.sort_array(_listed(F.col(b))))})
    rows = rows.withColumn("_c", F.size(F.array_intersect(numbered("_x"), numbered("_y"))))
    n, m = F.size("_x"), F.size("_y")
    alike, contained = F.when(n + m > 0, 2 * F.col("_c") / (n + m)).otherwise(1.0), F.when(F.least(n, m) > 0, F.col("_c") / F.least(n, m)).otherwise(0.0)
    return rows.withColumns({"_alike": F.when(where, alike), "_contained": F.when(where, contained)}).drop("_x", "_y", "_c")


def only_ones(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Pairs whose both sides have no other pair."""
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(*key, c))
    return pairs.withColumn("_l", n("old_pos")).withColumn("_r", n("new_pos")).where("_l = 1 AND _r = 1").drop("_l", "_r")


def uncrossed(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Pairs that no other pair of theirs crosses: all before them lie before, all behind them behind on both sides."""
    w = Window.partitionBy(*key).orderBy("old_pos")
    before, behind = F.max("new_pos").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.min("new_pos").over(w.rowsBetween(1, Window.unboundedFollowing))
    found = pairs.withColumn("_b", before).withColumn("_f", behind)
    return found.where((F.col("_b").isNull() | (F.col("_b") < F.col("new_pos"))) & (F.col("_f").isNull() | (F.col("_f") > F.col("new_pos")))).drop("_b", "_f")


#: The passes after that for equal words: what both sides have once, and the likeness and containment that suffice.
PASSES = [("same id", "id", SAME_ID, None), ("same place", "address", SAME_PLACE, SAME_PLACE_CONTAINED)]
#: What a unit holds, in the order of the columns that go to Python.
FIELDS = ("pos", "part", "id", "address", "cited", "said")


def pair_units(old: list[tuple], new: list[tuple]) -> list[tuple[int, int, str, float]]:
    """Pairs (i, j, via, alike) of two lists of ``FIELDS`` by the passes of ``paired``; units without a place in the text or a part have none."""
    free = [{i for i, u in enumerate(side) if u[0] is not None and u[1] is not None and u[5] is not None} for side in (old, new)]
    out: list[tuple[int, int, str, float]] = []
    bags: dict[str, Counter] = {}

    def bag(said: str) -> Counter:
        if said not in bags:
            bags[said] = Counter(said.split(" ")) if said else Counter()
        return bags[said]

    def at(field: int) -> Iterator[tuple[list[int], list[int]]]:
        """Free units of both sides that have one part and one value of the field."""
        seen: dict = {}
        for s, side in enumerate((old, new)):
            for i in free[s]:
                value = side[i][field]
                if value is not None:
                    seen.setdefault((side[i][1], tuple(value) if field == 4 else value), ([], []))[s].append(i)
        return ((a, b) for a, b in seen.values() if a and b)

    def take(pairs: list[tuple[int, int, str, float]]) -> None:
        out.extend(pairs)
        free[0].difference_update(p[0] for p in pairs)
        free[1].difference_update(p[1] for p in pairs)

    # A missing text is compared with nothing, but its unit counts where others have to stand alone.
    mute = [{i for i, u in enumerate(side) if u[0] is not None and u[1] is not None and u[5] is None} for side in (old, new)]
    take([(a[0], b[0], "same words", 1.0) for a, b in at(5) if len(a) == len(b) == 1])
    for via, name, least, contained in PASSES:
        now = []
        free = [f | m for f, m in zip(free, mute, strict=True)]
        for a, b in at(FIELDS.index(name)):
            if len(a) == len(b) == 1 and old[a[0]][5] is not None and new[b[0]][5] is not None:
                x, y = bag(old[a[0]][5]), bag(new[b[0]][5])
                c, n, m = (x & y).total(), x.total(), y.total()
                alike = 2 * c / (n + m) if n + m else 1.0
                if alike >= least or contained is not None and min(n, m) and c / min(n, m) >= contained:
                    now.append((a[0], b[0], via, alike))
        take(now)
    free = [f - m for f, m in zip(free, mute, strict=True)]
    near = []
    for a, b in at(4):
        if len(old[a[0]][4]):
            x, y = [bag(old[i][5]) for i in a], [bag(new[j][5]) for j in b]
            near += [(a[i], b[j], alike) for alike, i, j in similar_units(x, y, READDRESSED)]
            near += [(i, j, 1.0) for i in a if not old[i][5] for j in b if not new[j][5]]
    olds, news = Counter(i for i, _, _ in near), Counter(j for _, j, _ in near)
    in_part = defaultdict(list)
    for i, j, alike in near:
        if olds[i] == news[j] == 1:
            in_part[old[i][1]].append((old[i][0], new[j][0], i, j, alike))
    for pairs in in_part.values():
        pairs.sort()
        behind = [float("inf")] * len(pairs)
        for k in range(len(pairs) - 1, 0, -1):
            behind[k - 1] = min(behind[k], pairs[k][1])
        most = float("-inf")
        for (_, place, i, j, alike), least_behind in zip(pairs, behind, strict=True):
            if most < place < least_behind:
                out.append((i, j, "readdressed", alike))
            most = max(most, place)
    return out


def met(laws: DataFrame, key: list[str]) -> DataFrame:
    """Every unit of ``laws`` (key, the arrays old and new of ``FIELDS``) once: key, part, old_pos, new_pos, old_id, new_id, via, alike; a unit that no pass pairs has neither via nor other side."""
    schema = StructType([laws.schema[k] for k in key] + [StructField("part", StringType())] + [StructField(c, LongType()) for c in ("old_pos", "new_pos")] + [StructField(c, StringType()) for c in ("old_id", "new_id", "via")] + [StructField("alike", DoubleType())])
    columns = [f"_{side}_{c}" for side in ("old", "new") for c in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                some = batch.slice(first, ROWS)
                lists = [some.column(c).to_pylist() for c in columns]
                at, rows = [], []
                for row, fields in enumerate(zip(*lists, strict=True)):
                    old, new = (list(zip(*[f or () for f in fields[s : s + len(FIELDS)]], strict=True)) for s in (0, len(FIELDS)))
                    pairs = pair_units(old, new)
                    found = [(old[i][1], old[i][0], new[j][0], old[i][2], new[j][2], via, alike) for i, j, via, alike in pairs]
                    found += [(old[i][1], old[i][0], None, old[i][2], None, None, None) for i in sorted(set(range(len(old))).difference(p[0] for p in pairs))]
                    found += [(new[j][1], None, new[j][0], None, new[j][2], None, None) for j in sorted(set(range(len(new))).difference(p[1] for p in pairs))]
                    at += [row] * len(found)
                    rows += found
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]
                told = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
                keys = [some.column(k).take(pa.array(at, pa.int64())) for k in key]
                yield pa.RecordBatch.from_arrays(keys + told, names=schema.names)

    flat = laws.select(*key, *[F.col(f"{side}.{c}").alias(f"_{side}_{c}") for side in ("old", "new") for c in FIELDS])
    return flat.mapInArrow(run, schema)


def paired(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Pair the units of two versions: key, old_pos, new_pos, via, alike.

    In this order, inside a part: the same words; the same id with likeness
    ``SAME_ID``; the same address with ``SAME_PLACE`` or the fewer words
    almost all among the others; the same citations with ``READDRESSED``, where
    both sides have one such candidate and no two such pairs cross. A unit that
    no pass pairs is removed or inserted (``changes``).
    """
    unit = lambda units: F.struct(F.col("pos").cast("long").alias("pos"), F.col("part").cast("string").alias("part"), "id", "address", "cited", _said(units).alias("said"))
    none = F.lit(None)
    rows = old.select(*key, unit(old).alias("old"), none.alias("new")).unionByName(new.select(*key, none.alias("old"), unit(new).alias("new")))
    for k in key:
        rows = rows.where(F.col(k).isNotNull())
    laws = rows.groupBy(*key).agg(F.collect_list("old").alias("old"), F.collect_list("new").alias("new"))
    found = met(laws, key).where("via IS NOT NULL")
    return written(found.select(*key, F.col("old_pos").cast(old.schema["pos"].dataType).alias("old_pos"), F.col("new_pos").cast(new.schema["pos"].dataType).alias("new_pos"), "via", "alike"), "paired")


def _kind() -> Column:
    return F.when(F.col("via") == "same words", "unchanged").when(F.col("via") == "readdressed", "readdressed").otherwise("changed")


def kinds(found: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``met`` as ``changes`` gives them: key, old_pos, new_pos, change."""
    return found.select(*key, "old_pos", "new_pos", F.when(F.col("new_pos").isNull(), "removed").when(F.col("old_pos").isNull(), "inserted").otherwise(_kind()).alias("change"))


def changes(old: DataFrame, new: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """Every unit once: key, old_pos, new_pos, change (unchanged, changed, readdressed, removed or inserted)."""
    rest = lambda u, pos: u.select(*key, F.col("pos").alias(pos)).join(pairs, [*key, pos], "left_anti")
    none = F.lit(None).cast("long")
    both = pairs.select(*key, F.col("old_pos").cast("long"), F.col("new_pos").cast("long"), _kind().alias("change"))
    gone = rest(old, "old_pos").select(*key, F.col("old_pos").cast("long"), none.alias("new_pos"), F.lit("removed").alias("change"))
    come = rest(new, "new_pos").select(*key, none.alias("old_pos"), F.col("new_pos").cast("long"), F.lit("inserted").alias("change"))
    return both.unionByName(gone).unionByName(come)


def composed(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Pairs over three versions: where the first version's unit stands in the third: key, old_pos, mid_pos, new_pos."""
    a = first.select(*key, "old_pos", F.col("new_pos").alias("mid_pos"))
    return a.join(second.select(*key, F.col("old_pos").alias("mid_pos"), "new_pos"), [*key, "mid_pos"]).select(*key, "old_pos", "mid_pos", "new_pos")


def scoped(first: DataFrame, second: DataFrame, parts: tuple[DataFrame, DataFrame, DataFrame], key: list[str]) -> DataFrame:
    """Parts of two later versions that belong to a draft: key, part, side (second or third), scope (kept, cut or added).

    ``first`` pairs parts of the draft with the second version (key, old_part,
    new_part), ``second`` those of the second with the third; ``parts`` lists the
    parts of the three. A part of the second version is kept if the draft pairs
    with it; one of the third is cut if it pairs with a part that is cut, and
    added on the way if it pairs with none. Where the draft pairs with nothing,
    nothing is cut.
    """
    _, mid, last = parts
    drafted = first.select(*key, F.col("new_part").alias("part")).distinct()
    any_pair = drafted.select(*key).distinct().withColumn("_any", F.lit(True))
    held = mid.join(drafted.withColumn("_in", F.lit(True)), [*key, "part"], "left").join(any_pair, key, "left")
    cut = F.col("_any").isNotNull() & F.col("_in").isNull()
    mid_scope = held.select(*key, "part", F.lit("second").alias("side"), F.when(cut, "cut").otherwise("kept").alias("scope"))
    through = second.select(*key, F.col("old_part").alias("part"), F.col("new_part").alias("_to")).join(mid_scope.select(*key, "part", "scope"), [*key, "part"]).select(*key, F.col("_to").alias("part"), "scope")
    last_scope = last.join(through, [*key, "part"], "left").select(*key, "part", F.lit("third").alias("side"), F.coalesce("scope", F.lit("added")).alias("scope"))
    return mid_scope.unionByName(last_scope)


#: Lists of so many parts that have a word are added up by numpy, shorter ones one by one. It changes no result.
LONG_LIST = 64


def best_parts(old: dict[str, Counter], new: dict[str, Counter], least: float) -> dict[str, tuple[str, float]]:
    """The part of ``new`` and the likeness that each part of ``old`` pairs with: the best of each side, at ``least`` of 2 * common words / all, alone at its score."""
    sides = [[(part, bag) for part, bag in side.items() if bag] for side in (old, new)]
    under: dict[str, list[tuple[int, int]]] = {}
    for j, (_, bag) in enumerate(sides[1]):
        for w, m in bag.items():
            under.setdefault(w, []).append((j, m))
    lists = {w: tuple(np.array(held).T) for w, held in under.items() if len(held) >= LONG_LIST}
    sizes = [bag.total() for _, bag in sides[1]]
    scores = []
    for i, (_, bag) in enumerate(sides[0]):
        common, often = [0] * len(sizes), np.zeros(len(sizes) if lists else 0, np.int64)
        for w, n in bag.items():
            if w in lists:
                often[lists[w][0]] += np.minimum(lists[w][1], n)
            else:
                for j, m in under.get(w, ()):
                    common[j] += n if n < m else m
        for j in often.nonzero()[0].tolist():
            common[j] += int(often[j])
        size = bag.total()
        scores += [(2 * c / (size + m), i, j) for j, (c, m) in enumerate(zip(common, sizes, strict=True)) if c and 2 * c / (size + m) >= least]
    best: list[dict[int, float]] = [{}, {}]
    for alike, *ends in scores:
        for side, end in zip(best, ends, strict=True):
            side[end] = max(alike, side.get(end, 0.0))
    tops = [(alike, i, j) for alike, i, j in scores if alike == best[0][i] == best[1][j]]
    olds, news = Counter(i for _, i, _ in tops), Counter(j for _, _, j in tops)
    return {sides[0][i][0]: (sides[1][j][0], alike) for alike, i, j in tops if olds[i] == news[j] == 1}


def followed_parts(laws: DataFrame, key: list[str], names: list[str], least: float = 0.5) -> DataFrame:
    """Every part of every version once: key, version (from 1, in the order of ``names``), part, next and alike: the part of the next version that it pairs with by ``best_parts``, if any.

    The columns ``names`` are arrays of units (part, said). Versions travel as one row, and a part's words are counted once for both its neighbours.
    """
    schema = StructType([laws.schema[k] for k in key] + [StructField("version", LongType()), StructField("part", StringType()), StructField("next", StringType()), StructField("alike", DoubleType())])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.float64()]

    def bags(parts: list[str] | None, said: list[str | None] | None) -> dict[str, Counter]:
        found: dict[str, Counter] = {}
        for part, text in zip(parts or (), said or (), strict=True):
            bag = found.setdefault(part, Counter())
            if text:
                bag.update(text.split(" "))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                some = batch.slice(first, ROWS)
                at, rows = [], []
                for row, lists in enumerate(zip(*[some.column(f"_{name}_{c}").to_pylist() for name in names for c in ("part", "said")], strict=True)):
                    each = [bags(*lists[v : v + 2]) for v in range(0, len(lists), 2)]
                    for version, (of, behind) in enumerate(zip(each, [*each[1:], {}], strict=True), 1):
                        pairs = best_parts(of, behind, least)
                        rows += [(version, part, *pairs.get(part, (None, None))) for part in of]
                        at += [row] * len(of)
                told = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
                keys = [some.column(k).take(pa.array(at, pa.int64())) for k in key]
                yield pa.RecordBatch.from_arrays(keys + told, names=schema.names)

    return laws.select(*key, *[F.col(f"{name}.{c}").alias(f"_{name}_{c}") for name in names for c in ("part", "said")]).mapInArrow(run, schema)


def pair_parts(old: DataFrame, new: DataFrame, key: list[str], least: float = 0.5) -> DataFrame:
    """Parts of two versions, given as rows, that pair by ``best_parts``: key, old_part, new_part, alike."""
    unit = lambda units: F.struct(F.col("part").cast("string").alias("part"), _said(units).alias("said"))
    none = F.lit(None)
    rows = old.select(*key, unit(old).alias("old"), none.alias("new")).unionByName(new.select(*key, none.alias("old"), unit(new).alias("new")))
    laws = rows.groupBy(*key).agg(F.collect_list("old").alias("old"), F.collect_list("new").alias("new"))
    found = followed_parts(laws, key, ["old", "new"], least).where("version = 1 AND next IS NOT NULL")
    return found.select(*key, F.col("part").cast(old.schema["part"].dataType).alias("old_part"), F.col("next").cast(new.schema["part"].dataType).alias("new_part"), "alike")
