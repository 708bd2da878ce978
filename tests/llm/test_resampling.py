"""Importance resampling against plain Python, over the table and odd inputs."""

import hashlib
import math
import re
import string
import zlib
from collections import Counter

import pytest

from strandline.llm import resampling

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def brute(rows, targets, percent=5, least=20, buckets=10_000):
    """Every row's (doc_id, n_features, weight, score) and the drawn ones in order."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(k, *grams(text)) for k, text in rows]
    s = Counter(bucket(f) for _, fs, _ in found for f in fs)
    t = Counter(bucket(f) for text in targets for f in grams(text)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in s}
    out = []
    for k, fs, n in found:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append((k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0]))
    return out, able[: math.floor(percent * len(able) / 100)]


def test_whole_table(spark, small):
    docs, target = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    got = resampling.resample(docs, target).collect()
    want, top = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == sorted(x[:4] for x in want)
    assert [(r.doc_id, r.rank) for r in sorted(got, key=lambda r: r.rank or 0) if r.rank] == [(x[0], i + 1) for i, x in enumerate(top)] and top


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 300)
    base = " ".join(f"w{i}" for i in range(25))
    rows = [(None, base), (1, None), (2, ""), (3, "\x00\x01 ,;"), (4, "one"), (5, "one two"), (6, "Ärger é 9 Ünder_score"), (7, "word " * 5000), (None, base)] + [(8, base)] * 30 + [(9 + k, base + f" x{k}") for k in range(30)]
    docs = spark.createDataFrame([(k, t, 1, 2.0, "z") for k, t in rows], "doc_id long, text string, score int, weight double, rank string")
    target = spark.createDataFrame([("w1 w2 w3",), (None,)], "text string")
    got = resampling.resample(docs, target, percent=50).collect()
    want, top = brute(rows, ["w1 w2 w3", None], percent=50)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(x[:4] for x in want)
    # Repeated rows have ranks of their own, one after another.
    drawn = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank)
    assert [r for r, _, _ in drawn] == list(range(1, len(top) + 1)) and [(k, s) for _, k, s in drawn] == [(x[0], x[3]) for x in top]
    assert resampling.resample(docs.limit(0), target).count() == 0
    flat = resampling.resample(docs.where("doc_id = 4"), target.limit(0)).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in flat] == [(4, 1, None)]


def test_a_row_repeated_for_a_third_is_counted_not_gathered(spark):
    from pyspark.sql import functions as F

    scored = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit(30).alias("n_words"), F.lit(1).alias("n_features"), F.lit(5).alias("weight"), F.when(F.col("id") % 3 == 0, F.lit(50)).otherwise(F.col("id") % 97).alias("score"), F.lit(True).alias("eligible"))
    got = resampling.drawn(scored, 60).collect()
    ranks = sorted((r.rank, -r.score, r.doc_id) for r in got if r.rank)
    want = sorted((-r.score, r.doc_id) for r in got)[:1800]
    assert len(got) == 3000 and [(s, k) for _, s, k in ranks] == want and [r for r, _, _ in ranks] == list(range(1, 1801))


def test_counters_do_not_overflow():
    import numpy as np
    import pyarrow as pa

    assert resampling.packed(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())), np.uint16).to_pylist() == [b"\x01\x00\x02\x00", b"", b"\x03\x00"]
    with pytest.raises(OverflowError):
        resampling.packed(pa.array([[1 << 16]], pa.list_(pa.int64())), np.uint16)
