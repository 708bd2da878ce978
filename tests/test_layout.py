"""Two-column pages put together again from runs."""

import math
import random

from pyspark.sql import functions as F

from strandline.operators import layout
from strandline.plans import layout_queries as plans


def test_pages_come_back(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("text IS NOT NULL").collect()}
    lines = {}
    for r in plans.two_column_lines(spark, small).collect():
        lines.setdefault(r.doc_id, []).append((r.page, r.line, r.left_text, r.right_text, r.spanning))
    bare = lambda t: t.split(") ", 1)[1] if t.startswith("(") and t[1:2].isdigit() else t
    right_ones = []
    for k, text in docs.items():
        said = [[w for w in line.split(" ") if w] for line in text.split("\n")]
        want = [w for w in said if w]
        got = [(bare(left), bare(right), span) for _, _, left, right, span in sorted(lines.get(k, []))]
        assert len(got) == len(want)
        right_ones += [(left, right, span) in ((" ".join(w[:6]), " ".join(w[6:12]), ""), ("", "", " ".join(w[:4]))) for (left, right, span), w in zip(got, want, strict=True)]
    # Where a page has few lines, a blank behind a short first word can be as empty as the gutter.
    assert sum(right_ones) > 0.97 * len(right_ones)


def test_border_and_lines(spark):
    runs = spark.createDataFrame([(1, 0, 10.0, 700.0, 400.0, "left"), (1, 0, 430.0, 700.5, 300.0, "right"), (1, 0, 10.0, 690.0, 410.0, "left"), (1, 0, 300.0, 680.0, 300.0, "across"), (1, 0, 9.0, 680.0, 0.0, " "), (2, 0, 5.0, 5.0, 10.0, "only")], "doc int, page int, x double, y double, width double, text string")
    borders = {r.doc: (r.border, r.ink) for r in layout.column_border(runs, ["doc"], 842.0).collect()}
    # 421 to 429 are crossed by the spanning run alone; 421 is the middle.
    assert borders == {1: (421, 1), 2: (421, 0)}
    got = {(r.doc, r.line): (r.left, r.right, r.spanning) for r in layout.two_columns(runs, ["doc"], ["page"], 842.0).collect()}
    assert got == {(1, 0): ("left", "right", ""), (1, 1): ("left", "", ""), (1, 2): ("", "", "across"), (2, 0): ("only", "", "")}
    assert layout.two_columns(runs.where(F.lit(False)), ["doc"], ["page"], 842.0).count() == 0


def test_border_is_where_every_position_tells(spark):
    rng = random.Random(8)
    rows = [(k, 0, float(rng.randrange(350, 460)) + rng.choice([0, 0.5]), 700.0, rng.choice([3.0, 20.5, 60.0, 200.0]), "w") for k in range(60) for _ in range(rng.randrange(1, 12))]
    runs = spark.createDataFrame(rows, "doc int, page int, x double, y double, width double, text string")
    for width in (842.0, 841.0, 777.0):
        low, high = int(width * 0.45), math.ceil(width * 0.55)
        want = {}
        for k in range(60):
            spans = [(math.floor(x), math.ceil(x + w)) for d, _, x, _, w, _ in rows if d == k]
            ink, _, at = min((sum(a <= p <= b for a, b in spans), abs(p - width / 2), p) for p in range(low, high + 1))
            want[k] = (at, ink)
        found = layout.column_border(runs, ["doc"], width)
        assert {r.doc: (r.border, r.ink) for r in found.collect()} == want
        # No row per position of the strip is made, and runs are read once.
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan and "Join" not in plan


def test_runs_are_dealt_once(spark, small):
    plan = plans.two_column_lines(spark, small)._jdf.queryExecution().executedPlan().toString()
    # Runs are dealt once for the pages; the others deal counts of the border. Documents are cut up once for each.
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("REPARTITION_BY_COL") == 1 and plan.count("FileScan") == 2
