"""Paragraph trees against a stack, and back to their lines."""

import random
from collections import Counter

from pyspark.sql import functions as F

from strandline.operators import trees


def stacked(lines):
    """Parents and paths by a stack: {pos: (level, parent, path)}."""
    from re import fullmatch

    stack, found = [], {}
    for pos, line in enumerate(lines):
        level = next((k for k, m in enumerate(trees.MARKERS) if fullmatch(rf"(?s)\s*{m}(?:\s+.*)?", line or "")), trees.TEXT)
        while stack and stack[-1][0] >= level:
            stack.pop()
        found[pos] = (level, stack[-1][1] if stack else None, [p for _, p in stack] + [pos])
        stack.append((level, pos))
    return found


def test_trees_equal_a_stack(spark):
    rng = random.Random(3)
    marks = ["§ 5. ", "§ 12a ", "(1) ", "(2b)", "3. ", "a) ", "bb) ", "", "", "12) ", "§ "]
    docs = {k: [rng.choice(marks) + rng.choice(["text here", "", "more\tof it"]) for _ in range(rng.randrange(1, 60))] for k in range(40)}
    docs[40], docs[41], docs[None] = [None, "§ 1.", "(1) x", None], ["", ""], ["(1) only", "text"]
    rows = spark.createDataFrame([(k, p, line) for k, lines in docs.items() for p, line in enumerate(lines)], "doc long, pos long, line string")
    for chunk in (7, 4096):
        got = trees.tree(rows, ["doc"], "pos", "line", chunk).collect()
        assert len(got) == sum(map(len, docs.values()))
        want = {(k, p): v for k, lines in docs.items() for p, v in stacked(lines).items()}
        assert {(r.doc, r.pos): (r.level, r.parent, [x.pos for x in r.path]) for r in got} == want
        assert all(r.depth == len(r.path) - 1 for r in got)
    nodes = trees.tree(rows, ["doc"], "pos", "line")
    said = {r.doc: r.text.split() for r in trees.rendered(nodes, ["doc"]).collect()}
    assert said == {k: " ".join(x or "" for x in lines).split() for k, lines in docs.items()}
    parts = {(r.doc, r.pos): r.lines for r in trees.rendered(nodes, ["doc"], level=0).collect()}
    below = Counter((k, x) for (k, p), (_, _, path) in want.items() for x in path if want[(k, x)][0] == 0)
    assert parts == below


def test_addresses_name_one_node(spark):
    lines = ["§ 5. head", "(1) one", "a) x", "a) again", "(2) two", "closing words", "§ 6", "1. item"]
    nodes = trees.tree(spark.createDataFrame([(1, p, x) for p, x in enumerate(lines)], "doc int, pos long, line string"), ["doc"], "pos", "line")
    assert {r.address: r.pos for r in trees.by_address(nodes, ["doc"]).collect()} == {"§5": 0, "§5/(1)": 1, "§5/(2)": 4, "§6": 6, "§6/1.": 7}
    whole = trees.rendered(nodes, ["doc"]).first()
    assert whole.text == "\n".join(lines) and whole.plain == "head one x again two closing words item"
    empty = nodes.limit(0).select("doc", "pos", F.lit("x").alias("line"))
    assert trees.tree(empty, ["doc"], "pos", "line").count() == 0
