"""The training-data operators against brute force and over odd inputs."""

import glob
import gzip
import hashlib
import io
import os
import random
import re
import string
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from strandline.llm import langid, licenses, linededup, mixing, neardup, orderminhash, packing, pii, quality, queries, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, ties, and columns with clashing names."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    table = [
        (None, base, "en", "a", 1), (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "b", 3), (4, base, "en", "a", 70), (4, base, "en", "a", 70),
        (4, base + " fifteen", "en", None, 80), (5, "word " * 30000, "en", "a", 150000), (6, base, None, "b", 70), (7, "x", "de", "b", 1), (8, "été ß \U0001f600\n\nété\n|", "fr", "c", 9),
        (9, "12 34", "en", "c", 5), (10, "line of some length here\nline of some lengths here\nline of some length here", "en", "d", 80),
    ]
    found = spark.createDataFrame(table, SCHEMA)
    from pyspark.sql import functions as F

    return found.select("*", F.lit(7).alias("size"), F.lit("z").alias("kept"), F.lit(None).cast("string").alias("score"), F.lit(1).alias("mark"), F.lit("p").alias("sig"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_odd_inputs(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    given = odd.collect()
    ids = Counter(r.doc_id for r in given)
    per_row = {
        "mix": mixing.mix_summary, "order": orderminhash.fingerprint_documents, "pii": pii.find_personal_data, "near": neardup.near_duplicates, "lang": langid.predict_documents,
        "rules": lambda d: quality.rule_documents(d, labels), "lines": linededup.line_report, "licence": licenses.scan_documents,
    }
    got = {}
    for name, f in per_row.items():
        got[name] = f(odd).collect()
        assert Counter(r.doc_id for r in got[name]) == ids, name
        assert f(empty).count() == 0, name
    words = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in given)
    assert Counter((r.doc_id, r["size"]) for r in got["mix"]) == words and all(r.taken <= 2 * r["size"] for r in got["mix"])
    assert Counter((r.doc_id, r.n_words) for r in got["rules"]) == words
    assert {r.doc_id: r.kept for r in got["rules"]}[5] is False and not any(r.kept for r in got["rules"])
    assert Counter((r.doc_id, r.n_chars) for r in got["order"]) == Counter((r.doc_id, len(r.text or "")) for r in given)
    assert {r.doc_id for r in got["order"] if r.fingerprint == ""} == {1, 2, 3}
    assert {r.doc_id for r in got["lang"] if r.lang_pred == "und"} == {1, 2, 3, 9}
    assert {r.component_id for r in got["near"] if r.doc_id in (None, 4, 6)} == {4}
    assert {(r.doc_id, r.component_id) for r in got["near"] if r.doc_id not in (None, 4, 6)} == {(k, k) for k in ids if k not in (None, 4, 6)}
    # Of equal lines the null id's is the first; "line of some lengths here" is one edit away from the first line.
    dropped = {(r.doc_id, tuple(r.dropped)) for r in got["lines"]}
    assert {(None, ()), (4, (0,)), (4, ()), (6, (0,)), (10, (1, 2)), (8, (2,))} <= dropped | {(8, (2,))} and (1, ()) in dropped
    assert all(r.spans == "" for r in got["pii"])
    assert all(r.license is None for r in got["licence"])


def test_stages_keep_columns_of_any_name(spark, empty):
    from pyspark.sql import functions as F

    names = ["_mark", "_copy", "_runs", "_id", "_size", "_gone", "_row_mark", "_text", "_row", "row", "mark", "gone", "runs", "size", "copy", "lang_pred", "score", "key", "node", "h1", "n", "s", "doc id"]
    base = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, base, "en", "a", len(base)), (1, base, "en", "a", len(base)), (2, base + "\nthe rest of it", "en", "a", 0), (3, None, None, None, None), (None, "words alone here", "en", "b", 16)], SCHEMA)
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])
    for f in (langid.keep_identified, linededup.dedup_lines, neardup.keep_first, mixing.mixed_documents):
        found = f(docs)
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id if r.doc_id is not None else 'none'}" for r in rows for n in names)
        assert f(empty).count() == 0
    assert Counter(r.doc_id for r in langid.keep_identified(docs).collect()) == Counter([1, 1, 2, None])
    # Identical rows are one place in the order of lines and keep the same ones; n_chars follows.
    assert Counter((r.doc_id, r.text, r.n_chars) for r in linededup.dedup_lines(docs).collect()) == Counter({(1, base, len(base)): 2, (2, "the rest of it", 14): 1, (3, None, None): 1, (None, "words alone here", 16): 1})


def test_language_stage_decides(spark):
    words = {"en": "the water of that river was there with them and other things", "fr": "les eaux que nous avons dans cette maison pour notre vieux jardin", "ru": "вода которая была здесь вместе с другими вещами и людьми"}
    rng = random.Random(4)
    said = lambda lang, n: " ".join(rng.choices(words[lang].split(), k=n))
    rows = [(k, said(lang, 40), lang, "a", 1) for k, lang in enumerate(["en", "fr"] * 40)]
    rows += [(1000, said("en", 40), None, "a", 1), (1001, said("ru", 40), None, "a", 1), (1002, said("ru", 3), None, "a", 1), (1003, "12 34", "en", "a", 1), (1004, None, None, None, None), (1005, said("en", 15) + " " + said("ru", 45), None, "a", 1)]
    kept = {r.doc_id: r.lang for r in langid.keep_identified(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {k: lang for k, _, lang, _, _ in rows[:80]} | {1000: "en", 1002: kept[1002]}


def test_hot_keys_are_joined_whole(spark):
    from pyspark.sql import functions as F

    from strandline.llm import common

    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 2500).alias("k"), F.col("id").alias("v"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("members"), F.max("v").alias("top")).where("k <> 11")
    want = Counter((r.k, r.v, r.top) for r in rows.join(table, "k").collect())
    assert Counter((r.k, r.v, r.top) for r in common.joined_spread(rows, table, ["k"], "members").collect()) == want
    assert Counter((r.k, r.v, r.top) for r in common.joined_salted(rows, table, "k").collect()) == want
    assert common.hot_keys(rows, "k").agg(F.sum("_copies")).first()[0] <= 2 * common.HOT_KEYS


# Mixing.


def brute_targets(sizes):
    """Water filling by repetition, in exact steps."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, cut = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in cut)
        w = sum(weight[s] for s in order if s not in cut)
        share = {s: left * weight[s] / w if s not in cut else 2 * sizes[s] for s in order} if w else {s: 2 * sizes[s] for s in order}
        more = {s for s in order if s not in cut and share[s] >= 2 * sizes[s]}
        if not more:
            return share
        cut |= more


def test_mix(spark, docs, rows):
    got = mixing.mix_summary(docs).collect()
    sizes = defaultdict(int)
    for r in rows.values():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(WORD.findall(rows[r.doc_id].text or ""))
        assert r.source_size == sizes[rows[r.doc_id].source]
        assert r.target == pytest.approx(want[rows[r.doc_id].source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[rows[r.doc_id].source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_summary(docs.repartition(3)).collect()))


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 5, 16, 97, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), [F.lit(3)]).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_mixed_texts_are_words_of_their_documents(docs, rows):
    total = 0
    for r in mixing.mixed_documents(docs).collect():
        words = WORD.findall(r.text)
        assert not Counter(words) - Counter(WORD.findall(rows[r.doc_id].text))
        assert r.n_chars == len(r.text)
        total += len(words)
    assert total == sum(r.taken for r in mixing.mix_summary(docs).collect())


# Fingerprints.


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in orderminhash.fingerprint_documents(docs).collect()}
    ids = sorted(rows)
    for i, k in enumerate(ids):
        text, following = rows[k].text or "", rows[ids[(i + 1) % len(ids)]].text or ""
        half = len(text) // 2
        assert got[k].n_chars == len(text)
        assert got[k].edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    sigs = {k: brute_signature(rows[k].text, 60) for k in ids if 70 < len((rows[k].text or "").split()) < 120}
    assert len(sigs) > 5
    for k, sig in sigs.items():
        shown = [got[k].fingerprint[i : i + 8] for i in range(0, 512, 8)]
        assert sum(x == f"{y & 0xFFFFFFFF:08x}" for x, y in zip(shown, sig)) >= 63
        following = ids[(ids.index(k) + 1) % len(ids)]
        if following in sigs:
            assert got[k].near_next == pytest.approx(sum(x == y for x, y in zip(sig, sigs[following])) / 64, abs=0.04)
    by_text = defaultdict(set)
    for k in ids:
        by_text[rows[k].text].add(got[k].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(r.near_edited for r in got.values()) > sum(r.near_next for r in got.values())


def test_repeated_rows_get_one_row_each(spark):
    table = [(1, "a b c d e f"), (2, "g h i j k l")] * 3 + [(None, "m n o p q r"), (2, "s t u v w x y z"), (2, "s t u v w x y z")]
    got = orderminhash.fingerprint_documents(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in table)
    assert len({r for r in got if r.doc_id == 1}) == 1 and len({r for r in got if r.doc_id == 2}) == 2


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*values):
    """Spark's xxhash64: each value is hashed with the hash so far as seed; an int has 4 bytes, a long 8."""
    import xxhash

    h = 42
    for v in values:
        for x in v if isinstance(v, list) else [v]:
            data = x.encode() if isinstance(x, str) else x[0].to_bytes(4, "little") if isinstance(x, tuple) else (x & ((1 << 64) - 1)).to_bytes(8, "little")
            h = xxhash.xxh64_intdigest(data, h & ((1 << 64) - 1))
    return signed(h)


def brute_signature(text, rounds=400):
    """The definition: per order the TUPLE least numbered k-mers by their first dart on it, in text order, hashed."""
    hashes = [xx(w) for w in WORD.findall(text or "")]
    k = orderminhash.K
    grams = [xx(*hashes[i : i + k]) for i in range(len(hashes) - k + 1)] if len(hashes) >= k else [xx("short", hashes)] if hashes else []
    seen, ids = Counter(), []
    for g in grams:
        ids.append(xx(g, (seen[g],)))
        seen[g] += 1
    best = [dict() for _ in range(orderminhash.SKETCHES)]
    for place, x in enumerate(ids):
        for c in range(rounds):
            r = xx(x, c << 48) & ((1 << 64) - 1)
            best[(r >> 58) ^ 32].setdefault(place, (c, r >> 18 & ((1 << 30) - 1)))
    out = []
    for found in best:
        least = sorted(sorted(found, key=lambda p: (found[p], p))[: orderminhash.TUPLE])
        out.append(xx([ids[p] for p in least]) >> 32)
    return out if ids else []


def test_signature_is_the_definition(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "c", "été"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 40)] + [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (12, 60, 200)] + ["", None, " \n "]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", orderminhash.signature(F.col("t")).alias("s")).collect()
    same = total = 0
    for r in got:
        want = brute_signature(texts[r.i])
        assert len(r.s) == len(want)
        same, total = same + sum(x == y for x, y in zip(r.s, want)), total + len(want)
    assert same >= total - 1


def test_long_and_short_texts_share_their_orders(spark):
    from pyspark.sql import functions as F

    # The number of rounds and the threshold depend on the length; what is least does not.
    words = [f"w{i}" for i in range(1400)]
    cases = [" ".join(words[:n]) for n in (900, 955, 970, 1400)]
    sig = [r.s for r in spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", orderminhash.signature(F.col("t")).alias("s")).orderBy("i").collect()]
    like = lambda x, y: sum(p == q for p, q in zip(sig[x], sig[y])) / 64
    assert like(0, 1) > 0.75 and like(1, 2) > 0.9 and 0.3 < like(1, 3) < 0.65


def test_likeness_of_short_texts_is_steady(spark):
    from statistics import pstdev

    from pyspark.sql import functions as F

    rows = [(" ".join(f"q{k}_{i}" for i in range(12)), " ".join([*(f"q{k}_{i}" for i in range(11)), "zz"])) for k in range(100)]
    got = [r.l for r in spark.createDataFrame(rows, "a string, b string").select(orderminhash.likeness(orderminhash.signature(F.col("a")), orderminhash.signature(F.col("b"))).alias("l")).collect()]
    assert pstdev(got) < 0.07


def test_order_matters_and_repeats_count(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    a = " ".join(words)
    blocks = [words[i : i + 20] for i in range(0, 400, 20)]
    rng.shuffle(blocks)
    cases = [a, " ".join(sum(blocks, [])), " ".join(words[:390]), "x y " * 300, "x y " * 600, " ".join(f"v{i}" for i in range(400))]
    sig = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", orderminhash.signature(F.col("t")).alias("s")).orderBy("i").collect()]
    like = lambda x, y: sum(p == q for p, q in zip(sig[x], sig[y])) / orderminhash.SKETCHES
    assert like(0, 2) > 0.8 and like(0, 5) == 0
    # Most k-mers of the shuffled text are the same; their order is not.
    assert 0.1 < like(0, 1) < 0.75
    assert like(3, 4) < 1


# Personal data.

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and max(map(int, m[0].split("."))) > 255 or name == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(docs, rows):
    for r in pii.find_personal_data(docs).collect():
        base = brute_spans(rows[r.doc_id].text or "")
        shown = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("a1.@+- 2(9") for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("a" * 200000 + "1" * 200000) == []


def test_odd_digits_do_not_end_the_search(spark):
    texts = ["zz 1.2.3.\u00b2 x", "\u0661\u0662\u0663 9.9.9.\u0669", "please call 5551234567 \u00b2\u00b3 now", None, "", "@", "1." * 50000, "a@b " * 20000]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        base = brute_spans(text or "")
        assert got[k].n_ip == sum(kind == 1 for _, kind, _ in base)
    assert got[2].spans == "phone:12:22" and got[0].spans == ""


def test_words_around_a_number_decide():
    field = pii.default_field()
    for text, want in [("please call 5551234567 now", 1), ("order 5551234567 of today", 0), ("phone 5551234567", 1), ("invoice 5551234567 is due", 0)]:
        assert len(pii.added_spans([text], [[]], field)[0]) == want, text


def test_chains_hold_every_candidate_and_its_context():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice(["x", "y", "1", "a@b"]) for _ in range(rng.randint(0, 25))]
        text = " ".join(words)
        at = [m.span() for m in re.finditer(r"\S+", text)]
        near = {i + d for i, w in enumerate(words) if w in ("1", "a@b") for d in range(-pii.CONTEXT, pii.CONTEXT + 1)}
        chains = pii.chains_of(text)
        got = [s for chain in chains for s in chain]
        assert sorted(got) == got and len(set(got)) == len(got)
        assert {at.index(s) for s in got} == {i for i in near if 0 <= i < len(words)}


def test_decoding_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    names = [f"f{i}" for i in range(6)]
    field = pii.Field({n: i for i, n in enumerate(names)}, rng.normal(size=(6, len(pii.LABELS))), rng.normal(size=(len(pii.LABELS),) * 2))
    chains = [[[names[rng.integers(6)], names[rng.integers(6)]] for _ in range(n)] for n in (1, 2, 3, 4, 3, 1)]
    for chain, path in zip(chains, field.decode(chains)):
        score = field.scores(chain)

        def value(p):
            steps = sum(field.move[a, b] + pii.FORBIDDEN[a, b] for a, b in zip(p, p[1:]))
            return pii.START[p[0]] + steps + sum(score[t, k] for t, k in enumerate(p))

        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(chain)), key=value)
        assert value(tuple(path)) == pytest.approx(value(best))


def test_slopes_are_differences_of_the_likelihood():
    import numpy as np

    data = pii.examples(pii.labelled_table(1, 5)[:12])
    rng = np.random.default_rng(1)
    emit, move = rng.normal(size=(len(data.index), len(pii.LABELS))) / 5, rng.normal(size=(len(pii.LABELS),) * 2) / 5
    _, d_emit, d_move = data.likelihood(emit, move)
    for weights, slope in ((emit, d_emit), (move, d_move)):
        for _ in range(12):
            at = tuple(rng.integers(n) for n in weights.shape)
            weights[at] += 1e-4
            up = data.likelihood(emit, move)[0]
            weights[at] -= 2e-4
            down = data.likelihood(emit, move)[0]
            weights[at] += 1e-4
            assert slope[at] == pytest.approx((up - down) / 2e-4, abs=1e-4)


def test_field_on_held_out_rows():
    field = pii.default_field()
    right = wrong = missed = 0
    for text, spans in pii.labelled_table(6, 99):
        got = {(pii.KINDS[k], a, b) for a, k, b in pii.added_spans([text], [[]], field)[0]}
        right, wrong, missed = right + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert right / (right + missed) > 0.9 and right / (right + wrong) > 0.95


# Near duplicates.


def brute_components(rows, width, percent):
    sets = {}
    for k, text in rows.items():
        words = WORD.findall((text or "").translate(LOWER))
        sets[k] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()
    lists, parent = defaultdict(list), {k: k for k in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k in sorted(sets):
        shared = Counter(j for x in sets[k] for j in lists[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[j]) - n):
                a, b = sorted((root(j), root(k)))
                parent[b] = a
        for x in sets[k]:
            lists[x].append(k)
    return {k: (len(sets[k]), root(k)) for k in rows}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, rows, width, percent):
    rng = random.Random(width)
    texts = {k: r.text for k, r in rows.items()}
    words = [f"t{i}" for i in range(60)]
    for n in range(60):  # a chain and a cloud of edits around the threshold
        edited = list(words)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(len(edited))] = f"e{rng.randrange(9)}"
        texts[10000 + n] = " ".join(edited)
    short = [f"s{i}" for i in range(9)]
    for n in range(12):
        texts[20000 + n] = " ".join(short[: 3 + n % 7])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts, width, percent)
    got = {r.doc_id: r for r in neardup.near_duplicates(df, width, percent).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (k == r.component_id) for k, r in got.items())


def test_rows_without_id(spark):
    base = [f"w{i}" for i in range(60)]
    near, other, lone = [*base[:59], "edit"], [f"o{i}" for i in range(60)], [f"l{i}" for i in range(60)]
    table = [(None, base, "a"), (6, base, "b"), (9, base, "c"), (7, near, "d"), (None, other, "e"), (None, other, "f"), (None, [*other[:59], "edit"], "g"), (None, lone, "h"), (20, [], "i"), (None, [], "j"), (None, [], "k")]
    df = spark.createDataFrame([(k, " ".join(t), s) for k, t, s in table], "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, 5, 80).collect())
    assert got == Counter({(None, 6, False): 1, (6, 6, True): 1, (9, 6, False): 1, (7, 6, False): 1, (None, None, True): 4, (None, None, False): 2, (20, 20, True): 1})
    kept = sorted(r.source for r in neardup.keep_first(df, 5, 80).collect())
    assert len(kept) == 6 and [s for s in kept if s not in "efg"] == ["b", "h", "i", "j", "k"]
    # A text without an id still links the two texts at its sides.
    chain = [[f"c{i}" for i in range(k, 100 + k)] for k in (0, 8, 16)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in zip((1, None, 3), chain, strict=True)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, 5, 80).collect()} == {(1, 1, True), (None, 1, False), (3, 1, False)}


# Packing.


def test_tokens_are_the_tokenizers_own(rows):
    encode = packing.Tokens(packing.vocabulary())
    odd = ["", "<|endoftext|> a", "a\x1cb", "ΑΣ Σ", "İstanbul", "été", "don't won'T", "a b c", "日本語 text", "\0x", "x" * 3000, "🙂🙂 ok", "ǅ ﬁ", "1 2³ ½"]
    for text in [*odd, *(r.text for r in rows.values())]:
        ids = encode.whole.encode(text, add_special_tokens=False).ids
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids), text[:50]


def test_packing(docs, rows):
    encode = packing.Tokens(packing.vocabulary())
    got = packing.pack_documents(docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(rows)
    for k, parts in pieces.items():
        ids = encode(rows[k].text or "") + struct.pack("<I", 1)
        parts.sort(key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids) // 4, 4096)) and [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in parts)
        assert sum(r.length for r in parts) == len(ids) // 4 and all(r.length == 4096 for r in parts[:-1])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    least = -(-sum(r.length for r in got) // 4096)
    assert len(sequences) <= 1.05 * least + 1


def test_plan_places_every_piece_once():
    rng = random.Random(3)
    for turn in range(30):
        histogram = Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 20), 64, 33]) for _ in range(rng.choice([0, 1, 5, 100, 3000])))
        rows = packing.plan(dict(histogram), 64)
        used, filled = defaultdict(list), defaultdict(list)
        for length, first, many, sequence, offset in rows:
            used[length] += range(first, first + many)
            for i in range(many):
                filled[sequence + i].append((offset, length))
        assert {k: sorted(v) for k, v in used.items()} == {k: list(range(n)) for k, n in histogram.items()}
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64
        if sum(histogram.values()) > 1000:
            least = max(sum(k * n for k, n in histogram.items()) / 64, sum(n for k, n in histogram.items() if k > 32))
            assert len(filled) <= 1.04 * least + 2


# Archives.


def test_arc_forms_round_trip():
    for version in (1, 2):
        blocks = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n\nmore", b"", b"plain\r\n\r\ntext"]
        data = warc.arc_version_block(version, "f.arc", "20200102030405") + b"".join(warc.arc_record(version, f"http://h/{i} x", "2020010203", b) for i, b in enumerate(blocks))
        records = list(warc.read_arc(data))
        assert [r.block for r in records[1:]] == blocks and all(r.version == version for r in records) and [r.opens for r in records] == [True, False, False, False]
        archive = b"".join(warc.to_warc(r, "f") + b"\r\n\r\n" for r in records)
        found = list(warc.read_warc(io.BytesIO(archive)))
        assert [f["WARC-Type"] for f, _ in found] == ["warcinfo", "response", "resource", "resource"]
        assert found[1][0]["WARC-Date"] == "2020-01-02T03:00:00Z" and found[1][0]["WARC-Target-URI"] == "http://h/0%20x"
        assert found[1][0]["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(b"body\n\nmore").hexdigest()
        assert [b for _, b in found[1:]] == blocks and len({f["WARC-Record-ID"] for f, _ in found}) == 4
        # Concatenated archives of both forms, with a page whose address looks like a version block's.
        other = warc.arc_version_block(3 - version, "g.arc", "2021") + warc.arc_record(3 - version, "filedesc://page", "2021", b"HTTP/1.1 200 OK\r\n\r\nx")
        both = list(warc.read_arc(data + other))
        assert [r.opens for r in both] == [True, False, False, False, True, False] and both[-1].version == 3 - version
        assert b"WARC-Type: response" in warc.to_warc(both[-1], "f")
        for bad in (data[:-3], data[data.index(b"http://h/0") :]):
            with pytest.raises(ValueError):
                list(warc.read_arc(bad))
        with pytest.raises(ValueError):
            list(warc.read_warc(io.BytesIO(archive[:-9])))


def test_pages_that_repeat_an_id_are_judged_by_their_payload(spark, tmp_path):
    a, b = "a" * 1200, "ü²\r\n\r\nHTTP/1.1 é" * 200
    table = [(1, "u", a), (1, "u", b), (1, "u", "small"), (2, "filedesc://1 2", a), (3, "http://a b", b), (None, None, None), (None, "u", a), (4, "", ""), (5, "u", a), (5, "u", a)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string")
    size = {x: len(x.encode()) for x in (a, b, "small", "")}
    want = Counter({(1, size[a], "revisit", 5): 1, (1, size[b], "revisit", 3): 1, (1, 5, "response", None): 1, (2, size[a], "revisit", 5): 1, (3, size[b], "response", None): 1, (None, 0, "response", None): 1, (None, size[a], "response", None): 1, (4, 0, "response", None): 1, (5, size[a], "response", None): 2})
    got = warc.archive_pages(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == want
    assert warc.archive_pages(pages.limit(0)).count() == 0
    # Small archives: as many as needed, no record lost, no id given twice.
    path = str(tmp_path / "warc")
    warc.write_archives(pages.coalesce(1), path, archive_bytes=3000)
    again = warc.read_archives(spark, path).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in again) == want
    assert len({r.record_id for r in again}) == len(table) and len(glob.glob(f"{path}/archive=*")) > 2
    heads = [gzip.open(f).read() for f in glob.glob(f"{path}/archive=*/*.gz")]
    assert sum(h.count(b"WARC-Type: warcinfo") for h in heads) == len(heads) and any(b"WARC-Refers-To-Target-URI: http://a%20b" in h for h in heads)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    from tests.test_oracle import rows_of

    duck = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


# Languages.


def test_languages(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r for r in big.collect()}
    got = langid.predict_documents(big).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_filter_returns_all_languages_and_corrects():
    import numpy as np

    rng = np.random.default_rng(0)
    profiles = [np.unique(rng.integers(0, 1 << 60, 3000)) for _ in range(70)]
    profiles[69] = np.union1d(profiles[69], profiles[3])
    model = langid.Filter([f"l{i:02}" for i in range(70)], profiles)
    masks = model.masks(profiles[3])
    assert (masks[0] >> np.uint64(3) & np.uint64(1)).all() and (masks[1] >> np.uint64(5) & np.uint64(1)).all()
    other = model.masks(rng.integers(1 << 60, 1 << 61, 20000))
    rate = ((other[0] >> np.uint64(3)) & np.uint64(1)).mean()
    assert abs(rate - model.false_rate[3]) < 0.01


def test_decisions_agree_with_exact_sets(docs, rows):
    train = docs.where(~langid.held_out(docs["doc_id"]))
    model = langid.fit(train)
    texts = [r.text or "" for r in rows.values()][:150] + ["", "12 34", "ж", "é"]
    # What each language learned, as exact sets: found by asking for every trigram of its rows.
    learned = [set() for _ in model.languages]
    by_lang = defaultdict(list)
    for r in train.collect():
        by_lang[r.lang].append((r.text or "").replace("\0", " "))
    profiles = {lang: Counter(langid.trigrams(found)[0].tolist()) for lang, found in by_lang.items() if lang is not None}
    total = {lang: sum(c.values()) for lang, c in profiles.items()}
    for k, lang in enumerate(model.languages):
        for g, n in profiles[lang].items():
            rate = n / total[lang]
            if n > 1 and rate >= langid.SHARE * max(profiles[o][g] / total[o] for o in profiles):
                learned[k].add(g)
    agree = 0
    for text, (pred, _) in zip(texts, model.decide(texts)):
        grams = langid.trigrams([text])[0].tolist()
        if not any(c.isalpha() for c in text):
            assert pred == "und"
        counts = [sum(g in s for g in grams) for s in learned]
        agree += pred == "und" and not grams or bool(grams) and (max(counts) == 0 or pred == model.languages[counts.index(max(counts))])
    assert agree / len(texts) > 0.98


# Quality rules.


def test_counts(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality.rule_documents(docs, labels).collect():
        text = rows[r.doc_id].text or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated))
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        assert (r.base_failed, r.kept) == (failed, not failed)


def test_bounds_are_exact_binomial():
    from math import comb

    for k, n, p in [(0, 10, 0.2), (3, 50, 0.1), (10, 40, 0.4), (30, 40, 0.4), (40, 40, 0.4), (7, 9, 0.001)]:
        assert quality.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert quality.within_risk(0, 300, 0.01, 0.05) and not quality.within_risk(0, 298, 0.01, 0.05)
    assert not quality.within_risk(0, 0, 0.01, 0.05) and not quality.within_risk(5, 100, 0.05, 0.05)


def brute_verdicts(measured, labels, delta=quality.DELTA):
    """Rules, proposals, sequence and verdict with plain loops; measured: (doc_id, stratum, counts by name)."""
    def value(rule, m):
        return {"symbols": m["n_symbols"] / max(m["word_chars"], 1), "dup_lines": m["n_dup_lines"] / max(m["n_lines"], 1), "repeats": m["n_repeat_words"] / max(m["n_words"], 1), "short_words": -m["word_chars"] / max(m["n_words"], 1), "long_words": m["word_chars"] / max(m["n_words"], 1), "few_words": -m["n_words"]}[rule]

    failed = lambda m: m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
    hits = lambda m, r, i: value(r[0], m) > r[2][i - 1]
    held, limits = defaultdict(list), {}
    labelled = [(s, labels[k] == 1, zlib.crc32(str(k).encode()) % 4 == 0, m) for k, s, m in measured if k in labels and not failed(m)]
    for s in {x[0] for x in labelled if x[2]}:
        limits[s] = []
        for r in quality.RULES:
            bad = [m for t, good, first, m in labelled if t == s and first and not good]
            good = [m for t, g, first, m in labelled if t == s and first and g]
            limit = b0 = g0 = 0
            for i in range(1, quality.LEVELS + 1):
                b, g = sum(hits(m, r, i) for m in bad), sum(hits(m, r, i) for m in good)
                if b >= quality.LEAST_BAD and b > b0 and (b - b0) * len(good) >= quality.LIFT * (g - g0) * len(bad):
                    limit, b0, g0 = i, b, g
            limits[s].append(limit)
    rejects = lambda m, s, level: any(hits(m, r, min(level, limits[s][k])) for k, r in enumerate(quality.RULES) if limits[s][k])
    for s, good, first, m in labelled:
        if good and not first and s in limits:
            held[s].append(m)
    certified = {}
    for s, ms in held.items():
        level = 0
        while level < max(limits[s]) and quality.within_risk(sum(rejects(m, s, level + 1) for m in ms), len(ms), quality.RISK, delta / len(limits)):
            level += 1
        certified[s] = level
    return [(k, not failed(m) and not (certified.get(s) and rejects(m, s, certified[s]))) for k, s, m in measured], certified


def test_verdicts_against_plain_loops(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{folder}/labels.parquet")
    given = {r.doc_id: r.quality for r in labels.collect()}
    some = [r for r in docs.collect() if r.doc_id in given]
    docs = spark.createDataFrame(some, docs.schema)
    got = quality.rule_documents(docs, labels).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    want, certified = brute_verdicts([(r.doc_id, r.lang, r.asDict()) for r in got], given)
    assert {r.doc_id: r.kept for r in got} == dict(want) and len(names) == 6
    assert {r.lang: r.certified for r in got if r.certified} == {s: n for s, n in certified.items() if n} and any(certified.values())
    # The method's verdict counts: it rejects what the base rule lets pass, bad documents nearly alone.
    gone = Counter(given[r.doc_id] for r in got if not r.base_failed and not r.kept)
    assert gone[0] > 100 and gone[1] < 0.02 * sum(q == 1 for q in given.values())


def test_certified_levels_hold_the_risk(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(12000):
        good = i % 3 > 0
        symbols = rng.randint(0, 4) if good else rng.randint(0, 60)
        rows.append((i, 100, 100, symbols, 0, 0, 10, "en" if i % 2 else None))
        labels.append((i, int(good)))
    measured = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, lang string")
    chosen = {r.stratum: r for r in quality.calibrate(measured, spark.createDataFrame(labels, "doc_id long, quality int"), "lang").collect()}
    assert set(chosen) == {"en", None}
    for r in chosen.values():
        cutoff = quality.RULES[0][2][min(r.level, r.limits[0]) - 1]
        assert r.limits[1:] == [0] * 5 and 0.03 < cutoff < 0.06 and r.n_rejected <= quality.RISK * r.n_holdout
    few = quality.calibrate(measured.limit(100), spark.createDataFrame(labels, "doc_id long, quality int"), "lang").collect()
    assert all(r.level == 0 for r in few)
    assert quality.calibrate(measured, spark.createDataFrame([], "doc_id long, quality int"), "lang").count() == 0


# Lines.


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return len(b) - len(a) <= 1 and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def test_lines_against_all_pairs(spark):
    rng = random.Random(7)
    pool = ["".join(rng.choice("ab ") for _ in range(n)).strip() + "z" for n in (1, 2, 4, 9, 10, 11, 12, 13, 20, 40, 300, 1500) for _ in range(7)]
    texts = []
    for k in range(60):
        lines = []
        for _ in range(6):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                where = rng.randrange(len(line))
                line[where : where + rng.randint(0, 1)] = [rng.choice("abcé")] * rng.randint(0, 1)
            lines.append("".join(line))
        texts.append((k, "\n".join(lines)))
    occurrences = [(k, i, line.strip(" \t\n\x0b\f\r")) for k, t in texts for i, line in enumerate(t.split("\n"))]
    seen, want = [], defaultdict(list)
    for k, i, line in occurrences:
        if not line:
            continue
        if any(line == o or edit_one(line, o) for o in seen):
            want[k].append(i)
        seen.append(line)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.dropped for r in linededup.line_report(df).collect()}
    assert got == {k: want[k] for k, _ in texts}
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert all(kept[k] == "\n".join(line for i, line in enumerate(t.split("\n")) if i not in want[k]) for k, t in texts)


def test_short_and_very_long_lines(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abc de") for _ in range(60000)) + "z"
    texts = [(1, "Read more."), (2, "Read more"), (3, long), (4, long[:30000] + "X" + long[30001:]), (5, long + "q"), (6, long[1:]), (7, long[:100] + long[103:]), (8, "x"), (9, "y"), (10, "xyz")]
    got = {r.doc_id: r.dropped for r in linededup.line_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [0], 5: [0], 6: [0], 7: [], 8: [], 9: [0], 10: []}


# Licences.


def test_licenses(spark):
    import math

    files = [
        ("a/LICENSE", "All rights reserved."), ("a/b/x.txt", "nothing here"), ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("a/b/c/y.txt", "words only"),
        ("a/z.txt", "Some code that does a great many things, and more. Released under the MIT license, friends."), ("top.txt", None), ("ab/q.txt", "all the things are reserved seats"), (None, "Released under the MIT License."),
    ]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(files, "path string, text string"), []).collect()}
    assert [got[p].license for p, _ in files] == ["proprietary", "Apache-2.0", "Apache-2.0", "Apache-2.0", "MIT", None, None, "MIT"]
    assert [got[p].origin for p, _ in files] == ["file", "inherited", "file", "inherited", "header", "none", "none", "file"]
    assert got["a/b/c/y.txt"].licensed_by == "a/b"

    assert got["a/z.txt"].score == pytest.approx(brute_match("Released under the MIT license, friends.", licenses.TEMPLATES)[0])
    # A text with fewer anchors than needed, be they a template's heaviest, can come within reach of none.
    w = licenses.weights()
    for templates, anchors, hits in ((licenses.TEMPLATES, licenses.anchors(), 1), (licenses.FILE_TEMPLATES, licenses.anchors(whole=True), licenses.FILE_ANCHORS)):
        for _, text in templates:
            size = {t: (1 + math.log(n)) ** 2 * w[t] for t, n in licenses.counts_of(text).items()}
            most = sum(sorted((x for t, x in size.items() if t in anchors), reverse=True)[: hits - 1])
            assert math.sqrt((sum(x for t, x in size.items() if t not in anchors) + most) / sum(size.values())) < licenses.LEAST
            assert all(re.fullmatch(licenses.pattern(anchors), t) for t in anchors)


def brute_match(text, templates):
    """The greatest cosine over all templates, without any gate."""
    import math

    w, damp = licenses.weights(), lambda n: 1 + math.log(n)
    found = licenses.counts_of(text)
    norm = math.sqrt(sum(damp(n) ** 2 * w.get(t, licenses.unknown()) for t, n in found.items()))
    out = [(0.0, "")]
    for name, x in templates:
        other = licenses.counts_of(x)
        dot = sum(damp(n) * damp(other[t]) * w[t] for t, n in found.items() if t in other)
        out.append((dot / norm / math.sqrt(sum(damp(n) ** 2 * w[t] for t, n in other.items())) if norm else 0.0, name))
    return max(out)


def brute_sentences(text):
    """The lines' pieces, and the sentences of paragraphs with wrapped lines joined and comment marks dropped."""
    found = re.split(r"\n|(?<=[.!?;:]) ", text)
    bare = re.sub(r"(?m)^[ \t]*(?://+|#+|/?\*+/?|--+|;+|%+|<!--)[ \t]?", "", text)
    for paragraph in re.split(r"\n[ \t\r]*\n", bare) if "\n" in text else []:
        found += re.split(r"(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ\"'(])", " ".join(paragraph.split()))
    return found


def wrapped(text, mark, width=60):
    """A notice as a source file has it: wrapped over comment lines, under a copyright line."""
    import textwrap

    lines = ["Copyright (c) 2021 The Authors. All rights reserved.", "", *textwrap.wrap(text, width)]
    return "\n".join(f"{mark} {x}".rstrip() for x in lines) + "\n\nint main(void) { return 0; }\n"


def test_licences_of_real_files(spark):
    gnu = "{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."
    notices = [
        ("GPL-2.0", gnu.format("This program", "", "2")), ("GPL-3.0", gnu.format("Foo", "", "3")), ("LGPL-2.1", gnu.format("This library", "Lesser ", "2.1")), ("LGPL-3.0", gnu.format("Bar", "Lesser ", "3")), ("AGPL-3.0", gnu.format("This program", "Affero ", "3")),
        ("Apache-2.0", "Licensed to the Foundation under one or more agreements. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
        ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."), ("MIT", "Released under the MIT license, see LICENSE.txt for the whole of it."),
    ]
    files = [(name, wrapped(text, mark, width)) for name, text in notices for mark, width in (("//", 60), ("#", 44), (" *", 72))]
    known = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}
    texts = {name: open(f"/usr/share/common-licenses/{file}").read() for file, name in known.items() if os.path.exists(f"/usr/share/common-licenses/{file}")}
    if "GPL-3.0" in texts:
        texts["AGPL-3.0"] = texts["GPL-3.0"].replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC", 1).replace("29 June 2007", "19 November 2007", 1)
    files += texts.items()
    got = {r.k: r for r in licenses.detect(spark.createDataFrame([(k, text) for k, (_, text) in enumerate(files)], "k int, text string")).collect()}
    wrong = [(name, got[k].license, text[:60]) for k, (name, text) in enumerate(files) if got[k].license != name]
    assert len(wrong) <= 0.1 * len(files) and not [x for x in wrong if x[0].endswith("GPL-3.0")], wrong
    clean = spark.createDataFrame([("All rights are reserved for members of the club and their guests.",), ("Version 2 of the plan is due in June.",), ("© 2020 X. All rights reserved.",)], "text string")
    assert [r.license for r in licenses.detect(clean).collect()] == [None, None, "proprietary"]


def test_whole_licences_and_all_documents_against_brute_force(spark, docs, rows):
    texts = {k: r.text for k, r in rows.items()}
    texts |= {10000 + i: "Copyright (c) 2020 Some Body\n" + text.replace(". ", ".\n") for i, (_, text) in enumerate(licenses.FILE_TEMPLATES)}
    texts |= {20000: "mit license " * 3000, 20001: "", 20002: None}
    df = spark.createDataFrame([(k, t, f"f/{k}") for k, t in texts.items()], "doc_id long, text string, path string")
    got = {r.doc_id: r for r in licenses.detect(df).collect()}
    for k, text in texts.items():
        whole = brute_match(text or "", licenses.FILE_TEMPLATES)
        found = [whole] if whole[0] >= licenses.LEAST else [brute_match(s, licenses.TEMPLATES) for s in brute_sentences(text or "")]
        found = [x for x in found if x[0] >= licenses.LEAST]
        score, name = max([x for x in found if x[1] != "proprietary"] or found or [(0.0, None)])
        assert got[k].score == pytest.approx(score) and (got[k].license == name or sum(x[0] == pytest.approx(score) for x in found) > 1), k
    for i, (name, _) in enumerate(licenses.FILE_TEMPLATES):
        assert got[10000 + i].file_share == 1.0 and got[10000 + i].license == name


# Pipeline.


def brute_lines(docs):
    """Texts without lines that are equal to, or one edit away from, an earlier line; docs: (doc_id, text) with distinct ids, in order."""
    seen, out, by_length = set(), {}, defaultdict(set)
    for k, text in docs:
        if text is None:
            out[k] = None
            continue
        kept = []
        for line in text.split("\n"):
            bare = line.strip(" \t\n\x0b\f\r")
            if bare:
                gone = bare in seen or any(edit_one(bare, o) for n in (len(bare) - 1, len(bare), len(bare) + 1) for o in by_length[n])
                seen.add(bare)
                by_length[len(bare)].add(bare)
                if gone:
                    continue
            kept.append(line)
        out[k] = "\n".join(kept)
    return out


def test_pipeline(spark, small):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    base = [(5000 + i, t, "en", s, 0) for i, (t, s) in enumerate([(None, "a"), ("", "a"), ("12 34", None), ("x\nx\ny", None), ("ein ß\n\nwort", "b")])]
    docs = docs.unionByName(spark.createDataFrame(base, SCHEMA))
    given = sorted(docs.collect(), key=lambda r: r.doc_id)

    kept = stages["language_id"](spark, docs, small)
    assert kept.columns == names
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in given if letters(r.text))

    lines = stages["line_dedup"](spark, docs, small)
    assert lines.columns == names
    want = brute_lines([(r.doc_id, r.text) for r in given])
    found = {r.doc_id: r for r in lines.collect()}
    assert {k: r.text for k, r in found.items()} == want and all(r.n_chars == (None if r.text is None else len(r.text)) for r in found.values())

    near = stages["near_dedup"](spark, docs, small)
    labels = brute_components({r.doc_id: r.text for r in given}, 5, 80)
    assert near.columns == names and sorted(map(tuple, near.collect())) == sorted(tuple(r) for r in given if labels[r.doc_id][1] == r.doc_id)

    mixed = stages["mix_sources"](spark, docs, small)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in given:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text))
    target = brute_targets(sizes)
    assert mixed.columns == names and all(abs(taken[s] - target[s]) <= 1 for s in sizes if sizes[s])

    packed = stages["best_fit_packing"](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in given}
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096

    whole = corpus_pipeline.run(spark, small)
    assert {"doc_id", "sequence_id", "offset"} <= set(whole.columns) and whole.count() > 0


def test_pipeline_of_odd_tables(spark, tmp_path, odd, empty):
    import corpus_pipeline

    for name, table in (("odd", odd.drop("kept")), ("empty", empty)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name == "odd")
    # Rows without an id go through all stages.
    nameless = spark.createDataFrame([(None, "some words of a text that has no id", "en", "a", 1), (None, "other words of another text altogether", "en", "a", 1)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, nameless, "").count() == 2
    assert corpus_pipeline.STAGES[3][1](spark, nameless, "").count() >= 2


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
