"""Gazette search, versions in two times and explanations against plain rules."""

import datetime
import math
import random

from pyspark.sql import functions as F

from strandline.operators import gazette, reasons, timelines

DAY = datetime.date


def test_gazette_equals_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{min(int(rng.expovariate(0.4)), 14)}" for _ in range(400)]
    pick = lambda n: sorted(set(rng.choices(words, k=n)))
    entries = [(k, rng.random() < 0.5, pick(rng.randrange(1, 8)), DAY(2020, 1, 1) + datetime.timedelta(rng.randrange(900))) for k in range(120)]
    drafts = [(k, rng.random() < 0.5, [*core, *(["x", "y", "z"] if k % 2 else [])], core, DAY(2019, 11, 1) + datetime.timedelta(rng.randrange(900))) for k in range(120) for core in [pick(rng.randrange(1, 7))]]
    d = spark.createDataFrame(drafts, "id int, kind boolean, words array<string>, core array<string>, day date")
    e = spark.createDataFrame(entries, "no int, kind boolean, words array<string>, day date")
    got = {r.id: (r.no, r.candidates, r.state) for r in gazette.found_entries(d, e).collect()}
    want = {}
    for k, kind, whole, core, day in drafts:
        for reading in (whole, core) if 2 <= len(core) < len(whole) else (whole,):
            fit = [(2 * c / (len(reading) + len(w)), at, no) for no, of, w, at in entries if of == kind and 0 <= (at - day).days <= 730 and (c := len(set(reading) & set(w))) >= math.ceil(0.8 * len(reading) - 1e-9)]
            if fit:
                best = max(f for f, _, _ in fit)
                want[k] = (min((at, no) for f, at, no in fit if f >= best - 1e-4)[1], len(fit), "found")
                break
        else:
            want[k] = (None, 0, "before_records" if day < min(at for *_, at in entries) else "not_found")
    assert got == want and sum(v[2] == "found" for v in want.values()) > 20
    own = spark.createDataFrame([(7, 3), (9, 3), (None, 4)], "id int, no int")
    found = spark.createDataFrame([(1, 3), (2, 5), (3, 5), (4, None)], "id int, no int")
    assert {(r.no, r.id, r.via) for r in gazette.assigned(own, found).collect()} == {(3, 7, "record"), (4, None, "record"), (5, 2, "search")}


def test_as_of_rules(spark):
    far = DAY(2030, 1, 1)
    versions = spark.createDataFrame([
        ("a", 1, DAY(2020, 1, 1), DAY(2020, 12, 31), 2019, False, DAY(2020, 1, 1)), ("a", 2, DAY(2021, 3, 1), None, 2021, False, DAY(2021, 2, 1)),
        ("b", 1, DAY(2022, 6, 1), None, 2021, False, DAY(2021, 5, 1)), ("c", 1, DAY(2020, 1, 1), None, 2019, True, DAY(2020, 1, 1)),
        ("d", 1, DAY(2020, 1, 1), DAY(2020, 6, 1), 2019, False, DAY(2020, 1, 1)), ("d", 2, DAY(2020, 9, 1), None, 2021, True, DAY(2020, 1, 1)),
        ("e", 1, DAY(2020, 1, 1), None, 2019, False, DAY(2020, 1, 1)), ("e", 2, DAY(2020, 1, 1), DAY(2020, 2, 1), 2019, False, DAY(2020, 5, 1)),
    ], "unit string, version long, since date, until date, amended int, repeal boolean, recorded date")
    asked = {
        1: ("a", DAY(2020, 5, 1), far, 1, "in_force"), 2: ("a", DAY(2020, 12, 31), far, 1, "in_force"), 3: ("a", DAY(2021, 1, 15), far, None, "gap"), 4: ("a", DAY(2022, 1, 1), DAY(2021, 1, 1), None, "gap"),
        5: ("b", DAY(2022, 1, 1), far, 1, "promulgated"), 6: ("b", DAY(2021, 6, 1), far, None, "gap"), 7: ("c", DAY(2021, 1, 1), far, None, "repealed"), 8: ("d", DAY(2020, 7, 1), far, None, "gap"),
        9: ("e", DAY(2020, 3, 1), DAY(2020, 4, 1), 1, "in_force"), 10: ("e", DAY(2020, 3, 1), DAY(2020, 5, 1), None, "gap"), 11: ("e", DAY(2020, 1, 15), far, 2, "in_force"), 12: ("f", DAY(2020, 1, 1), far, None, "unknown"), 13: ("e", DAY(2020, 3, 1), DAY(2019, 1, 1), None, "unknown"),
    }
    hole = versions.where("unit = 'a'").withColumn("unit", F.lit("g")).withColumn("amended", F.lit(2022))
    asked[14] = ("g", DAY(2021, 1, 15), far, 1, "bridged")
    questions = spark.createDataFrame([(k, u, day, known) for k, (u, day, known, _, _) in asked.items()], "id int, unit string, day date, known date")
    got = {r.id: (r.version, r.how) for r in timelines.as_of(questions, versions.unionByName(hole), "unit").collect()}
    assert got == {k: v[3:] for k, v in asked.items()}
    runs = spark.createDataFrame([("a", 1, DAY(2020, 1, 1), DAY(2020, 1, 9), "x"), ("a", 2, DAY(2020, 1, 10), DAY(2020, 1, 20), "x"), ("a", 3, DAY(2020, 1, 21), None, "y"), ("a", 4, DAY(2020, 2, 1), DAY(2020, 2, 2), "y"), ("b", 1, DAY(2020, 1, 1), DAY(2020, 1, 9), "x"), ("b", 2, DAY(2020, 1, 12), None, "x")], "unit string, version long, since date, until date, text string")
    assert {(r.unit, r.text, str(r.since), str(r.until), r.versions) for r in timelines.coalesced(runs, "unit", "text").collect()} == {("a", "x", "2020-01-01", "2020-01-20", 2), ("a", "y", "2020-01-21", "None", 2), ("b", "x", "2020-01-01", "2020-01-09", 1), ("b", "x", "2020-01-12", "None", 1)}


def test_explained(spark):
    headings = {0: "Zu Z 1 bis 3 (§ 5):", 1: "Zu Z 2 (§ 6 Abs. 1 lit. a):", 2: "Zu § 7 Abs. 2:", 3: "Zu § 7:", 4: "Allgemeines", 5: "Zu Ziffer 9 – 4"}
    passages = spark.createDataFrame([(1, k, v) for k, v in headings.items()], "doc int, pos long, heading string")
    units = spark.createDataFrame([(1, 1, 1, "§5 abs1"), (1, 2, 2, "§6 abs1 lita"), (1, 3, 3, None), (1, 4, 2, "§9"), (1, 5, None, "§7 abs2 lita"), (1, 6, None, "§7 abs22"), (1, 7, 9, None), (1, 8, 4, None), (2, 1, 1, None)], "doc int, unit long, number int, address string")
    got = {(r.doc, r.unit): (r.passage, r.via, r.gap) for r in reasons.explained(units, passages, ["doc"]).collect()}
    assert got == {
        (1, 1): (0, "number", None), (1, 2): (1, "number", None), (1, 3): (0, "number", None), (1, 4): (None, None, "clash"), (1, 5): (2, "address", None), (1, 6): (3, "address", None),
        (1, 7): (5, "number", None), (1, 8): (None, None, "not named"), (2, 1): (None, None, "no passages"),
    }
