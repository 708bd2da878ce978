"""Spelling variants against plain Python, over the table and odd inputs."""

import random
import re
import string
import zlib
from collections import Counter

from strandline.llm import spelling

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    n = Counter()
    for k, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return n


def near(words):
    """Near words of each word, by the strings that deletions leave."""
    left = {}
    for w in words:
        for i in range(len(w)):
            left.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    out = {w: set() for w in words}
    for (_, rest), ws in left.items():
        for w in ws:
            out[w] |= ws - {w}
            if rest in out:
                out[w].add(rest)
                out[rest].add(w)
    return out


def brute(rows):
    n = {w: c for w, c in counted(rows).items() if len(w) >= 7 and c >= 2}
    by, form = near(n), {}
    for w, ws in by.items():
        best = min(ws, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(by[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = rows_of(spelling.variants(docs))
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == len(want) and set(got) == want and any(x[1] for x in want) and any(x[4] > 1 for x in want)


def test_divided_blocks_lose_no_pair(spark):
    rng = random.Random(8)
    words = {"".join(rng.choices("ab", k=rng.randrange(1, 11))) for _ in range(500)} | {"prefix" + "".join(rng.choices("abcdé", k=4)) for _ in range(300)} | {"x" * n for n in range(1, 40)} | {"ü" * 70 + c for c in "abc"}
    table = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    want = {(a, b) for a, bs in near(words).items() for b in bs}
    for most in (2, 16, 10_000):
        got = spelling.near_pairs(table, most).collect()
        assert len({frozenset((r.a, r.b)) for r in got}) == len(got) and {x for r in got for x in ((r.a, r.b), (r.b, r.a))} == want


def test_odd_rows(spark):
    rows = [(None, "Straßen straßen Œuvre naïveté"), (1, None), (2, ""), (3, "12 !!\n"), (4, "ÀÉÎÕÜabc ÀÉÎÕÜabc"), (5, "committee " * 400 + "comittee comittee commitee"), (5, "committee " * 400), (6, "Z" * 5000 + " " + "Z" * 5000 + " " + "Z" * 4999 + " " + "z" * 4999), (7, "roots \U0001f600 weather")] + [(8, "weather wether weathers weathers")] * 20
    docs = spark.createDataFrame([(k, t, "w", 1, "f") for k, t in rows], "doc_id long, text string, word string, n int, form string")
    got = rows_of(spelling.variants(docs))
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert ("comittee", "committee", "committee") in {x[:3] for x in got} or "comittee" not in counted(rows)
    assert spelling.variants(docs.limit(0)).count() == 0 and spelling.variants(docs.where("doc_id = 3")).count() == 0


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(19)] + [("a", "w3"), ("b", "c")], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(forms).collect()}
    assert got == {f"w{k}": "w19" for k in range(19)} | {"a": "w19", "b": "c"}
