"""Queries that SQL cannot express, over whole small tables, against plain Python versions."""

import re
from html.parser import HTMLParser

import pytest

from strandline.plans import registry


def rows(spark, small, name):
    return registry.queries()[name](spark, small).collect()


def documents(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def brute_components(a, b):
    soft = lambda x, y: x == y or len(x) >= 8 and len(y) >= 8 and (x.startswith(y) or y.startswith(x))
    forth, back = sum(any(soft(x, y) for y in b) for x in a), sum(any(soft(y, x) for x in a) for y in b)
    m, sa, sb = min(forth, back), " ".join(a), " ".join(b)
    lcp = next((k for k, (x, y) in enumerate(zip(sa, sb)) if x != y), min(len(sa), len(sb)))
    if not a or not b:
        return 0.0, 0.0, 0.0, 0.0
    return tuple(round(x + 1e-12, 3) for x in (m / (len(a) + len(b) - m), m / min(len(a), len(b)), forth / len(a), lcp / min(len(sa), len(sb))))


def test_title_components_of_all_acts(spark, small):
    parts = {r.p_partkey: (r.p_name, r.p_type) for r in spark.read.parquet(f"{small}/part.parquet").collect()}
    words = lambda t: list(dict.fromkeys(w for w in re.sub(r"[^\w§]+", " ", t.lower()).split() if len(w) >= 2 and w not in ("the", "of")))
    got = rows(spark, small, "title_similarity")
    assert {r.id for r in got} == set(parts)
    for r in got:
        a, b = map(words, parts[r.id])
        want = brute_components(a, b)
        assert (r.jac, r.cont, r.cov, r.lcp) == pytest.approx(want, abs=1e-9)
        jac, cont, cov, lcp = want
        score = (0.9 + 0.1 * max(jac, lcp) if min(len(a), len(b)) >= 2 else max(0.6, jac, lcp)) if cont >= 0.99 else max(0.8 * cont, jac, 0.9 * lcp, 0.9 * cov)
        assert r.score == pytest.approx(score, abs=6e-4)


def test_snippets_of_all_documents(spark, small):
    texts = documents(spark, small)
    got = {r.doc_id: r for r in rows(spark, small, "search_snippets")}
    assert set(got) == {k for k, t in texts.items() if "license" in (t or "").lower()} and got
    for k, r in got.items():
        at = texts[k].lower().index("license")
        plain = r.snippet.strip("…")
        assert "license" in plain.lower() and plain in texts[k] and len(plain) <= len("license") + 180
        assert r.snippet.startswith("…") == (at > 90) and r.snippet.endswith("…") == (at + 7 + 90 < len(texts[k]))
        # Cut at word borders.
        begin = texts[k].index(plain)
        assert begin == 0 or texts[k][begin - 1].isspace()
        line = next(x for x in texts[k].split("\n") if "license" in x.lower())
        assert r.line == line if len(line) <= 60 else line.startswith(r.line.rstrip("…").rstrip()) and len(r.line) <= 60


def test_offsets_of_all_hits(spark, small):
    texts = documents(spark, small)
    got = {}
    for r in rows(spark, small, "match_offsets"):
        got.setdefault(r.doc_id, []).append((r.begin, r.finish))
    for k, text in texts.items():
        if "license" in (text or "").lower():
            assert sorted(got[k]) == [m.span() for m in re.finditer("licensed?", text, re.I)]
    assert set(got) <= set(texts)


class Blocks(HTMLParser):
    """Headings, paragraphs, items and cells with their words, by the parser of the standard library."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if re.fullmatch("h[1-6]|p|li|td|th", tag):
            self.out.append([tag, ""])

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.out and not self.skip:
            self.out[-1][1] += data + " "


def test_blocks_of_all_pages(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r.page_id: r for r in rows(spark, small, "page_blocks")}
    same = 0
    for k, html in pages.items():
        parser = Blocks()
        parser.feed(html or "")
        blocks = [(tag, text) for tag, text in parser.out if text.strip()]
        heading = next((" ".join(t.split()) for tag, t in blocks if tag[0] == "h"), None)
        if k in got:
            # Text that follows a closed block belongs to none here and to the last one there: counts are what is compared.
            same += got[k].paragraphs == sum(tag == "p" for tag, _ in blocks) and (heading is None or heading.startswith(got[k].heading or ""))
    assert same >= 0.95 * len(got) and len(got) >= 0.9 * len(pages)


def test_tallies_are_near_exact_ones(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").collect()
    for r in rows(spark, small, "approximate_tallies"):
        mine = [e for e in events if e.event_type == r.event_type]
        assert abs(r.users - len({e.user_id for e in mine})) <= 0.15 * r.users + 1
        values = sorted(e.value for e in mine)
        assert values[int(0.45 * len(values))] <= r.median_value <= values[int(0.55 * len(values))]


def test_sentences_cover_their_documents(spark, small):
    from strandline.functions import arrow_text

    texts = documents(spark, small)
    got = {r.doc_id: r for r in rows(spark, small, "sentence_counts")}
    assert set(got) == set(texts)
    for k, text in texts.items():
        found = arrow_text.sentences_of(text or "")
        assert got[k].sentences == len(found) and " ".join(" ".join(found).split()) == " ".join((text or "").split())
        # A border stands only behind a mark and before a capital, a number or a quotation.
        assert all(re.search(r"[.!?][\"'”»)]*$", s) for s in found[:-1])
        if got[k].quote is not None:
            assert "license" in got[k].quote.lower() or got[k].quote.endswith("…")


def test_positions_number_all_rows(spark):
    from pyspark.sql import functions as F

    from strandline.operators import ordered

    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    got = ordered.positions(rows, [F.col("g"), F.desc("k")]).collect()
    assert [(r.g, r.k) for r in sorted(got, key=lambda r: r.pos)] == sorted(((r.g, r.k) for r in got), key=lambda x: (x[0], -x[1])) and sorted(r.pos for r in got) == list(range(1, 5001))
    assert ordered.positions(rows.limit(0), [F.col("k")]).count() == 0


def test_short_titles_in_texts(spark, tmp_path):
    from strandline.plans import document_queries

    docs = {1: "The Water Act of old", 2: "nothing waters here", 3: "a b", 4: None, 5: "one two three four five six"}
    cores = {1: "water act", 2: "water", 3: "b", 4: "two three four five six", 5: None, 6: "absent", 7: "wo three f"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(cores.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {k: [d for d, t in docs.items() if t and c in t.lower()] for k, c in cores.items() if c}
    assert {r.item_id: (r.docs, r.first_doc) for r in document_queries.title_in_text(spark, str(tmp_path)).collect()} == {k: (len(v), v[0]) for k, v in want.items() if v}
