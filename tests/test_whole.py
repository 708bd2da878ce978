"""Queries that read whole tables where a part would be cheaper, on cases that a part would miss."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import diffs
from strandline.plans import registry
from strandline.sources import scans


def test_every_turn_is_aligned_with_the_one_before(spark, small):
    turns = sorted((r.conv_id, r.turn) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn").distinct().collect())
    got = {(r.conv_id, r.turn): r for r in registry.queries()["unit_alignment"](spark, small).collect()}
    assert set(got) == {b for a, b in zip(turns, turns[1:]) if a[0] == b[0]}


def test_a_row_of_another_key_fails_the_scan(spark):
    rows = spark.createDataFrame([(1, 28), (2, 27), (3, None)], "inr int, gp int")
    assert scans.rechecked(rows.where("inr = 1"), {"gp": 28}).collect()[0].gp == 28
    for bad in ("inr <= 2", "inr = 3"):
        with pytest.raises(Exception, match="asked for gp 28"):
            scans.rechecked(rows.where(bad), {"gp": 28}).collect()


def conversations(spark, small):
    return sorted((r.conv_id, r.turn, r.text or "") for r in spark.read.parquet(f"{small}/conversations.parquet").collect())


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    i = j = 0
    steps = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            steps.append(("equal", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and table[i + 1][j] >= table[i][j + 1]:
            steps.append(("removed", a[i]))
            i += 1
        else:
            steps.append(("inserted", b[j]))
            j += 1
    return table[0][0], steps


def flat(pieces):
    return [(kind, w) for kind, words in pieces for w in words.split(" ")]


def test_word_differences_of_all_conversations(spark, small):
    turns = conversations(spark, small)
    pairs = [(a[2].split(), b[2].split()) for a, b in zip(turns, turns[1:]) if a[0] == b[0]]
    assert len(pairs) > 20
    for a, b in pairs:
        similar, pieces = diffs.word_diff(a, b)
        same, steps = brute_lcs(a, b)
        assert similar == pytest.approx(2 * same / (len(a) + len(b)) if a or b else 1.0)
        # Common ends are taken first; what lies between follows the table.
        head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert flat(pieces)[:head] == [("equal", w) for w in a[:head]] and sum(k == "equal" for k, _ in flat(pieces)) == same
        assert [w for k, w in flat(pieces) if k != "inserted"] == a and [w for k, w in flat(pieces) if k != "removed"] == b
        if head == 0 and (not a or not b or a[-1] != b[-1]):
            assert flat(pieces) == steps


def test_long_texts_are_compared_exactly():
    import random

    rng = random.Random(6)
    a = [rng.choice("abcdefgh") for _ in range(3000)]
    b = [w for w in a if rng.random() > 0.1] + ["z"]
    a, b = ["start", *a], ["other", *b]
    similar, pieces = diffs.word_diff(a, b)
    assert [w for k, w in flat(pieces) if k != "inserted"] == a and [w for k, w in flat(pieces) if k != "removed"] == b
    # All of the later text but its ends is a subsequence of the earlier one.
    assert similar == pytest.approx(2 * (len(b) - 2) / (len(a) + len(b)))


def brute_align(old, new, same_id=0.5, greedy=0.6):
    pairs, free_old, free_new = {}, set(range(len(old))), set(range(len(new)))
    like = lambda i, j: diffs.bag_similarity((old[i]["text"] or "").split(), (new[j]["text"] or "").split())
    once = lambda units, free, key: {units[i][key]: i for i in free if units[i].get(key) and sum(units[k].get(key) == units[i][key] for k in free) == 1}
    for key, rule in (("heading", lambda i, j: True), ("id", lambda i, j: not (old[i].get("heading") and new[j].get("heading")) and like(i, j) >= same_id)):
        a, b = once(old, free_old, key), once(new, free_new, key)
        for k in a:
            if k in b and rule(a[k], b[k]):
                pairs[a[k]] = b[k]
        free_old, free_new = free_old - set(pairs), free_new - set(pairs.values())
    for _, i, j in sorted((-like(i, j), i, j) for i in free_old for j in free_new if (old[i]["text"] or "").strip()):
        if like(i, j) >= greedy and i in free_old and j in free_new:
            pairs[i] = j
            free_old.discard(i)
            free_new.discard(j)
    return pairs


def test_alignment_against_all_pairs(spark, small):
    import random

    rng = random.Random(1)
    unit = lambda: {"heading": rng.choice([None, None, "A", "B", "C"]), "id": rng.choice([None, "1", "2", "3"]), "text": rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9)))}
    for _ in range(150):
        old, new = [unit() for _ in range(rng.randint(0, 9))], [unit() for _ in range(rng.randint(0, 9))]
        assert {i: j for i, j in diffs.align(old, new) if i is not None and j is not None} == brute_align(old, new)
    turns = conversations(spark, small)
    for a, b in list(zip(turns, turns[1:]))[:60]:
        x, y = ([{"heading": None, "id": None, "text": s} for s in t[2].split(". ")] for t in (a, b))
        assert {i: j for i, j in diffs.align(x, y) if i is not None and j is not None} == brute_align(x, y)


def test_articles_are_paired_per_package(spark):
    columns = "law string, pos long, title string, name string, number string"
    old = spark.createDataFrame([("a", 0, "law of water use", None, None), ("a", 1, "x", "N", None), ("a", 2, "y", None, "3"), ("b", 0, "alone", None, None), ("c", 0, "gone", None, None)], columns)
    new = spark.createDataFrame([("a", 0, "law of water supply use", None, None), ("a", 1, "q", None, "3"), ("a", 2, "w", "N", None), ("b", 0, "other", None, None), ("d", 0, "new", None, None)], columns)
    got = {tuple(r) for r in diffs.paired_articles(old, new, "law").collect()}
    assert got == {("a", 0, 0, "similar title"), ("a", 1, 2, "same name"), ("a", 2, 1, "number"), ("b", 0, 0, "only")}


def test_whole_passages_are_sought(spark, tmp_path):
    long = "An opening that the documents share with others, of some length, then what only this passage says at its end"
    items = [(1, long), (2, "Verfassungsgerichtshof Verwaltungsgerichtshof"), (3, "Short one"), (4, "nowhere to be found in any of them"), (5, None), (5, None)]
    docs = [(1, "before " + long + "after"), (1, "before " + long + "after"), (None, "x" + long.upper()), (2, long[:70] + " and goes on"), (3, "a verfassungsgerichtshof verwaltungsgerichtshof."), (4, "no short oNe"), (5, None), (6, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.queries()["title_in_text"](spark, str(tmp_path)).collect()}
    assert got == {(1, 3, 1), (2, 1, 3), (3, 1, 4)}
