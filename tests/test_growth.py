"""Queries on rows that grow past what the smallest tables hold: long packages, common words, long documents."""

import random
from collections import Counter
from datetime import date, timedelta

from pyspark.sql import functions as F

from strandline.functions import similarity
from strandline.operators import amend, boundaries, diffs, links, timelines, versions
from strandline.plans import boundary_queries, link_queries, version_queries


def test_shared_words_by_sets(spark):
    rng = random.Random(9)
    rows = [(i, sorted(rng.sample("abcdef", rng.randrange(1, 4)))) for i in range(60)] + [(100, ["z"]), (101, []), (102, None)]
    want = {}
    for i, a in rows:
        shared = [len(set(a or []) & set(b or [])) for j, b in rows if j != i]
        if any(shared):
            want[i] = (max(shared), sum(n > 0 for n in shared))
    df = spark.createDataFrame(rows, "id long, words array<string>")
    found = links.shared_words(df, df, "id", "words")
    assert {r.id: (r.most, r.candidates) for r in found.collect()} == want
    # Rows of one set are joined once: pairs do not grow with the rows.
    plan = links.shared_words(df.union(df.select(df.id + 1000, "words")), df.union(df.select(df.id + 1000, "words")), "id", "words")
    assert {r.id % 1000: r.most for r in plan.collect()} == {i: len(w) for i, w in rows if w}


def test_a_package_of_more_articles_than_numerals(spark, tmp_path):
    # Roman numerals end at XX; an article behind it has none (package 7 numbers so, 13 prints so).
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_linenumber int, l_tax double, l_discount double, l_returnflag string"
    spark.createDataFrame([(k, i, 1, 1.0, 20.0, 1, 0.05, 0.0, "N") for k in (7, 13) for i in range(23)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"w{i} x{i}", "SMALL") for i in range(23)], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    articles, _ = boundary_queries.packages(spark, str(tmp_path))
    numerals = {r["index"]: r.numeral for r in articles.where("package = 7").collect()}
    assert (numerals[0], numerals[19], numerals[20], numerals[22]) == ("I", "XX", None, None)
    for query in ("law_boundaries", "package_verdicts", "rows_of_laws"):
        rows = getattr(boundary_queries, query)(spark, str(tmp_path)).collect()
        assert {r.package for r in rows} == {7, 13}, query


def unit_rows(rng, n):
    return [(1, p, str(p // 3), str(p), f"§ {p % 4}", [f"§ {p % 4}"], [rng.choice("aabbbcdefgh") for _ in range(rng.randrange(0, 9))]) for p in range(n)]


def test_lines_of_packages_are_shuffled_once(spark, small, monkeypatch):
    # Titles are shuffled with the lines for what is written of all packages, and neither is read again behind it.
    tables, written = [], boundaries.written
    monkeypatch.setattr(boundaries, "written", lambda frame, name: tables.append(frame) or written(frame, name))
    found = boundary_queries.rows_of_laws(spark, small)
    assert "p_name" not in found._jdf.queryExecution().executedPlan().toString() and len(tables) == 1
    tables[0].collect()
    plan = tables[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len([line for line in plan.splitlines() if "- Exchange hashpartitioning(l_orderkey" in line]) == 1 and "ReusedExchange" in plan
    # A row keeps what else it has; a row without a package or a place has no answer.
    rows = spark.createDataFrame([("p", 1, "a"), ("p", 1, "b"), ("p", None, "c"), (None, 1, "d")], "package string, pos long, said string")
    drafted = spark.createDataFrame([("p", 0, "1", ["x"], True)], "package string, index int, numeral string, words array<string>, amends boolean")
    printed = spark.createDataFrame([("p", 0, "1", ["x"])], "package string, pos long, numeral string, words array<string>")
    assert sorted(tuple(r) for r in boundaries.assigned(rows, printed, drafted, ["package"]).collect()) == [("p", 1, "a", 0), ("p", 1, "b", 0)]


UNITS = "doc int, pos int, part string, id string, address string, cited array<string>, words array<string>"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_parts_are_paired_with_one_shuffle(spark):
    rng = random.Random(3)
    old = unit_rows(rng, 40)
    new = [(*r[:6], r[6][1:] + ["x"] if i % 5 == 0 else r[6]) for i, r in enumerate(old)]
    bags = [{}, {}]
    for units, bag in zip((old, new), bags, strict=True):
        for r in units:
            bag.setdefault(r[2], Counter()).update(r[6])
    alike = {(a, b): 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) for a, x in bags[0].items() for b, y in bags[1].items() if x & y}
    alike = {k: v for k, v in alike.items() if v >= 0.5}
    top = [(a, b) for (a, b), v in alike.items() if v == max(w for k, w in alike.items() if k[0] == a) == max(w for k, w in alike.items() if k[1] == b)]
    want = {(a, b) for a, b in top if sum(k[0] == a for k in top) == sum(k[1] == b for k in top) == 1}
    found = versions.pair_parts(spark.createDataFrame(old, UNITS), spark.createDataFrame(new, UNITS), ["doc"])
    assert exchanges(found) == 1
    assert {(r.old_part, r.new_part) for r in found.collect()} == want and want


def test_a_document_s_parts_are_paired_within_its_row(spark, small, monkeypatch):
    rng = random.Random(8)
    bag = lambda: Counter({w: rng.randrange(1, 4) for w in rng.sample("abcdefgh", rng.randrange(0, 6))})
    for n in (0, 1, 6, 150):
        old, new = ({str(p): bag() for p in range(n)} for _ in range(2))
        alike = {(a, b): 2 * (x & y).total() / (x.total() + y.total()) for a, x in old.items() for b, y in new.items() if x & y and 2 * (x & y).total() / (x.total() + y.total()) >= 0.5}
        best = [{}, {}]
        for ends, v in alike.items():
            for side, end in zip(best, ends, strict=True):
                side.setdefault(end, []).append(v)
        top = {(a, b): v for (a, b), v in alike.items() if v == max(best[0][a]) == max(best[1][b])}
        ends = [Counter(k[side] for k in top) for side in (0, 1)]
        assert versions.best_parts(old, new, 0.5) == {a: (b, v) for (a, b), v in top.items() if ends[0][a] == ends[1][b] == 1}
    tables = []
    monkeypatch.setattr(version_queries, "written", lambda frame, name: tables.append(frame) or frame)
    found = version_queries.scoped_laws(spark, small)
    # Words are neither written nor met by joins: a row of the one table is a part.
    assert [t.columns for t in tables] == [["doc_id", "version", "part", "next", "alike"]]
    assert "words" not in found._jdf.queryExecution().executedPlan().toString()


def test_likeness_counts_repeated_words(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.choice("aab") for _ in range(rng.randrange(0, 6))), " ".join(rng.choice("abbc") for _ in range(rng.randrange(0, 6)))) for _ in range(80)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in versions.likeness(df, df.a.isNotNull(), "a", "b").collect():
        a, b = Counter(r.a.split()), Counter(r.b.split())
        c, n, m = (a & b).total(), a.total(), b.total()
        assert abs(r._alike - (2 * c / (n + m) if n + m else 1.0)) < 1e-12 and abs(r._contained - (c / min(n, m) if min(n, m) else 0.0)) < 1e-12


def test_a_version_is_replaced_by_the_next_one_for_its_beginning(spark):
    day = lambda n: date(2020, 1, 1) + timedelta(days=n)
    rng = random.Random(7)
    rows = [(u, v, day(rng.randrange(6)), None, 2020, False, day(rng.randrange(6))) for u in range(6) for v in range(9)]
    # A version without a beginning hides no other, one without a day of record is never known.
    rows += [(0, 90, None, None, 2020, False, day(5)), (1, 91, day(0), None, 2020, False, None)]
    asked = [(u * 10 + k, u, day(5), day(k)) for u in range(6) for k in range(6)]
    want = {}
    for i, u, at, known in asked:
        seen = [r for r in rows if r[0] == u and r[6] is not None and r[6] <= known]
        last = [r for r in seen if r[2] is not None and r[2] <= at and not any(o[2] == r[2] and (o[6], o[1]) > (r[6], r[1]) for o in seen)]
        want[i] = max(last, key=lambda r: (r[2], r[1]))[1] if last else None
    versions_ = spark.createDataFrame(rows, "unit int, version long, since date, until date, amended int, repeal boolean, recorded date")
    questions = spark.createDataFrame(asked, "id int, unit int, day date, known date")
    assert {r.id: r.version for r in timelines.as_of(questions, versions_, "unit").collect()} == want


def test_title_tokens_are_made_once_a_row(spark, small):
    plan = link_queries.title_similarity(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") + plan.count("split(") < 12 and "RepartitionByExpression" in plan
    rows = [("abc", "abd"), ("abc", "abcd"), ("", "a"), ("x", "x"), ("ä𝒳b", "ä𝒳c"), ("ab", "ba"), (None, "a")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    assert [r.n for r in got.select("i", similarity.common_prefix(got.a, got.b).alias("n")).sort("i").collect()] == [2, 3, 0, 1, 2, 0, 0]


def test_instructions_need_no_frame_per_document(spark):
    trees = spark.createDataFrame([(k, str(p), f"t{p}") for k in range(50) for p in range(1, 4)] + [(None, "1", "x")], "doc int, path string, text string")
    lines = spark.createDataFrame([(k, i, line) for k in range(60) for i, line in enumerate(["Delete 2.", "Delete 9."])], "doc int, pos int, line string")
    found = amend.apply_instructions(trees, lines, "doc")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "MapInPandas" in plan
    got = Counter((r.doc, r.path, r.state, r.reason) for r in found.collect())
    want = Counter({(None, "1", "applied", None): 1})
    for k in range(60):
        want.update([(k, "1", "applied", None), (k, "3", "applied", None)] if k < 50 else [(k, None, "refused", "no such place")])
        want.update([(k, None, "refused", "no such place")])
    assert got == want


def test_units_are_paired_without_sorting_their_texts(spark, small):
    for name in ("repaired_units", "renumbered_units", "followed_units"):
        df = getattr(version_queries, name)(spark, small)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "collect_list(struct(pos" not in plan, name
        # What is sorted or windowed, if anything, is what pairing left: numbers, no texts.
        above = plan.split("MapInArrow")[0]
        assert "said" not in above and "cited" not in above, name
    assert not any(r.n > 1 for r in version_queries.version_units(spark, small).groupBy("doc_id", "version", "part", "id").agg(F.count("*").alias("n")).collect())


def test_passes_of_units_without_words_or_part():
    unit = lambda pos, part, i, address, said, cited=("c",): (pos, part, i, address, list(cited), said)
    old = [unit(1, "I", "1", "a", "x y"), unit(2, None, "2", "b", "same"), unit(3, "I", "3", "c", None), unit(4, "I", "4", "d", ""), unit(5, "I", "5", "e", "p q r s t")]
    new = [unit(1, "I", "1", "a", "x z"), unit(2, None, "2", "b", "same"), unit(3, "I", "3", "c", "w"), unit(4, "I", "9", "q", ""), unit(5, "I", "8", "r", "p q r s u"), unit(6, "I", "5", "e", "v")]
    assert {(old[i][0], new[j][0], via) for i, j, via, _ in versions.pair_units(old, new)} == {(1, 1, "same id"), (4, 4, "same words"), (5, 5, "readdressed")}
    # A unit whose words are missing still keeps its number from being the only one.
    assert versions.pair_units([unit(1, "I", "1", "a", "x y"), unit(2, "I", "1", "b", None)], [unit(1, "I", "1", "q", "x y z", ())]) == []


def test_units_need_no_frame_per_key(spark):
    columns = "law string, turn int, pos int, heading string, id string, text string"
    old = spark.createDataFrame([(k, t, p, None, str(p), f"{k} {t} words {p}") for k in "abc" for t in range(40) for p in (2, 0, 1)] + [(None, 1, 0, None, "0", "x")], columns)
    new = spark.createDataFrame([(k, t, p, None, str(p), f"{k} {t} words {p}" if p else None) for k in "bcd" for t in range(40) for p in (1, 0)], columns)
    found = diffs.aligned_units(old, new, ["law", "turn"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan
    got = Counter((r.law, r.line, r.old_pos, r.new_pos, r.kind, r.new_text is None) for r in found.collect())
    want = Counter({(None, 0, 0, None, "removed", True): 1})
    for k in "bc":
        want.update({(k, 0, None, 0, "inserted", True): 40, (k, 1, 0, None, "removed", True): 40, (k, 2, 1, 1, "unchanged", False): 40, (k, 3, 2, None, "removed", True): 40})
    want.update({("a", p, p, None, "removed", True): 40 for p in range(3)} | {("d", 0, None, 0, "inserted", True): 40, ("d", 1, None, 1, "inserted", False): 40})
    assert got == want


def test_periods_need_one_sort_and_no_table_of_runs(spark):
    day = lambda n: date(2020, 1, 1) + timedelta(days=n)
    rng = random.Random(10)
    rows = [(rng.choice([1, 2, 3, None]), v, rng.choice([None] + [day(n) for n in range(12)]), rng.choice([None, *[day(n) for n in range(2, 16)]]), rng.choice(["a", "b", None])) for v in range(120)]
    found = timelines.coalesced(spark.createDataFrame(rows, "unit int, version long, since date, until date, text string"), "unit", "text")
    want = Counter()
    for unit in (1, 2, 3, None):
        runs, ended, said = [], None, None
        for _, _, since, until, text in sorted((r for r in rows if r[0] == unit), key=lambda r: (r[2] is not None, r[2] or day(0), r[1])):
            if ended is None or said != text or since is not None and (since - ended).days > 1:
                runs.append((text, [], []))
            runs[-1][1].append(since)
            runs[-1][2].append(until or date(9999, 12, 31))
            ended, said = max(ended or date.min, until or date(9999, 12, 31)), text
        for text, sinces, untils in runs:
            want[unit, text, min((s for s in sinces if s), default=None), max(untils) if max(untils) < date(9999, 12, 31) else None, len(sinces)] += 1
    assert Counter(tuple(r) for r in found.select("unit", "text", "since", "until", "versions").collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan
