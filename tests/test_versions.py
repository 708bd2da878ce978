"""Pairs over versions, certain chains and renumberings against plain Python."""

import random
from collections import defaultdict
from itertools import combinations

from strandline.operators import chains, versions
from strandline.plans import version_queries as plans


def test_certain_is_on_every_longest_chain():
    rng = random.Random(5)
    for _ in range(300):
        values = [rng.randrange(9) for _ in range(rng.randrange(0, 9))]
        rising = [c for n in range(len(values) + 1) for c in combinations(range(len(values)), n) if all(values[a] < values[b] for a, b in zip(c, c[1:], strict=False))]
        longest = [c for c in rising if len(c) == max(map(len, rising))]
        assert chains.certain(values) == sorted(set(longest[0]).intersection(*longest)) if values else chains.certain(values) == []


def runs(pairs):
    """Runs of one shift on the certain chain of (old, new)."""
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    kept = [pairs[i] for i in chains.certain([b for _, b in pairs])]
    out = []
    for a, b in kept:
        if out and out[-1][2] == b - a:
            out[-1][1], out[-1][3] = a, out[-1][3] + 1
        else:
            out.append([a, a, b - a, 1])
    return {tuple(r) for r in out}


def test_versions_over_the_table(spark, small):
    units = defaultdict(dict)
    for r in plans.version_units(spark, small).collect():
        units[r.doc_id, r.version][r.pos] = r
    changed = plans.repaired_units(spark, small).collect()
    pairs = {(r.doc_id, r.old_pos): r.new_pos for r in changed if r.old_pos is not None and r.new_pos is not None}
    # Every unit is there once.
    assert sorted((r.doc_id, r.old_pos) for r in changed if r.old_pos is not None) == sorted((d, p) for (d, v), u in units.items() if v == 1 for p in u)
    assert sorted((r.doc_id, r.new_pos) for r in changed if r.new_pos is not None) == sorted((d, p) for (d, v), u in units.items() if v == 2 for p in u)
    # Units were made in place, so a pair should join what came of the same line: nearly all do.
    same = [units[d, 1][a].place == units[d, 2][b].place for (d, a), b in pairs.items()]
    assert sum(same) / len(same) > 0.98
    kept = sum(u.place in {x.place for x in units[d, 2].values()} for (d, v), us in list(units.items()) if v == 1 for u in us.values())
    assert sum(same) / kept > 0.95
    by_part = defaultdict(list)
    for (d, a), b in pairs.items():
        by_part[d, units[d, 1][a].part].append((int(units[d, 1][a].id), int(units[d, 2][b].id)))
    want = {(d, part, *r) for (d, part), ps in by_part.items() for r in runs(ps)}
    assert {(r.doc_id, r.part, r["first"], r["last"], r["shift"], r.pairs) for r in plans.renumbered_units(spark, small).collect()} == want
    followed = plans.followed_units(spark, small).collect()
    assert {(r.doc_id, r.old_pos, r.mid_pos) for r in followed} <= {(d, a, b) for (d, a), b in pairs.items()}
    third = [units[r.doc_id, 1][r.old_pos].place == units[r.doc_id, 3][r.new_pos].place for r in followed]
    assert sum(third) / len(third) > 0.97


def test_passes(spark):
    def unit(pos, text, id, address=None, cited=()):
        return (1, pos, "I", id, address, sorted(cited), text.lower().split())

    schema = "doc int, pos long, part string, id string, address string, cited array<string>, words array<string>"
    old = spark.createDataFrame([unit(1, "same words here", "1"), unit(2, "a b c d e f g h", "2", "§ 1"), unit(3, "k l m n", "3", "§ 2"), unit(4, "r s t u v w x y z one", "4", "§ 24 lit d", ["§ 24"]), unit(5, "gone", "5")], schema)
    new = spark.createDataFrame([unit(1, "x is new", "1"), unit(2, "same words here", "2"), unit(3, "k l m n and far more words than there were", "9", "§ 2"), unit(4, "a b c d e f g q", "7", "§ 1"), unit(5, "r s t u v w x y z two", "8", "§ 24 Abs 1 lit d", ["§ 24"])], schema)
    got = {(r.old_pos, r.new_pos): r.via for r in versions.paired(old, new, ["doc"]).collect()}
    assert got == {(1, 2): "same words", (2, 4): "same place", (3, 3): "same place", (4, 5): "readdressed"}
    kinds = {(r.old_pos, r.new_pos): r.change for r in versions.changes(old, new, versions.paired(old, new, ["doc"]), ["doc"]).collect()}
    assert kinds == {(1, 2): "unchanged", (2, 4): "changed", (3, 3): "changed", (4, 5): "readdressed", (5, None): "removed", (None, 1): "inserted"}
    # Two candidates on one side, or two pairs that cross, give no pair.
    pairs = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (1, 3, 6), (1, 7, 8), (1, 7, 9)], "doc int, old_pos long, new_pos long")
    assert {(r.old_pos, r.new_pos) for r in versions.uncrossed(versions.only_ones(pairs, ["doc"]), ["doc"]).collect()} == {(3, 6)}
