"""Language identification with language-bitmask n-gram filters.

Every learned language owns one bit. A character trigram is hashed to a few
slots of one bit-sliced Bloom filter; the AND of the slots' masks is the set of
all languages whose profile contains the trigram. A text's score per language
is the popcount of that bit over its trigrams, less the false positives the
filter is expected to give, and the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows used to learn one language at most (in expectation).
SAMPLE_ROWS = 4000
#: Trigrams in one language's profile at most.
PROFILE = 20000
#: Hash functions of the filter.
PROBES = 3
#: A language keeps a trigram only if its rate there is this share of the highest rate anywhere.
SHARE = 0.25
#: Share of a text's trigrams that one language has to contain for the text to be in it, judged from so many trigrams on.
KNOWN = 1 / 2
JUDGED = 50
#: Characters handled by one numpy pass at most (whole texts; a longer text is a pass of its own).
PASS_CHARS = 2_000_000

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter (general category L)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of all texts and, for each, the number of its text.

    Texts are lower-cased, runs of other characters become one space, and a
    space stands at both ends; a trigram packs three code points into 63 bits.
    """
    joined = "\0".join(texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    ends = codes == 0
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, 32)
    text_no = np.cumsum(ends)
    # A NUL inside a text would shift the numbering: callers replace it.
    keep = is_letter | ends
    keep[1:] |= is_letter[:-1]
    codes, text_no = codes[keep], text_no[keep]
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # One space between words; the separator itself serves as the space at the ends.
    codes = np.concatenate(([32], codes, [32]))
    text_no = np.concatenate((text_no[:1], text_no, text_no[-1:]))
    again = np.concatenate(([False], (codes[1:] == 32) & (codes[:-1] == 32)))
    codes, text_no = codes[~again], text_no[~again]
    grams = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    # Trigrams whose middle is a space say nothing about words; those also are the only ones that span texts.
    inside = codes[1:-1] != 32
    return grams[inside], text_no[1:-1][inside]


def passes(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Cut a batch into runs of whole texts of about ``PASS_CHARS`` characters."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        text = (text or "").replace("\0", " ")
        if run and size + len(text) > PASS_CHARS:
            yield start, run
            start, size, run = i, 0, []
        run.append(text)
        size += len(text)
    if run:
        yield start, run


class Filter:
    """A Bloom filter whose slots hold a bit per language, in 64-bit slices."""

    def __init__(self, languages: list[str], profiles: list[np.ndarray], prior: int = 0):
        entries = len(np.unique(np.concatenate(profiles))) if profiles else 0
        self.languages, self.prior = languages, prior
        self.bits = max(10, int(np.ceil(np.log2(8 * max(1, entries)))))
        self.slices = np.zeros((max(1, -(-len(languages) // 64)), 1 << self.bits), dtype=np.uint64)
        for k, grams in enumerate(profiles):
            bit = np.uint64(1 << (k % 64))
            for p in range(PROBES):
                self.slices[k // 64][self.slots(grams, p)] |= bit
        fill = [((self.slices[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))]
        self.false_rate = np.array(fill) ** PROBES

    def slots(self, grams: np.ndarray, probe: int) -> np.ndarray:
        x = grams.astype(np.uint64) * _MULT[probe]
        x ^= x >> np.uint64(29)
        return ((x * _MULT[(probe + 1) % 3]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each trigram, the set of languages that contain it (one row per slice)."""
        out = self.slices[:, self.slots(grams, 0)]
        for p in range(1, PROBES):
            out &= self.slices[:, self.slots(grams, p)]
        return out

    def tally(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many trigrams of each text each language contains, false positives taken off, and how many each text has."""
        n = len(texts)
        grams, text_no = trigrams(texts)
        text_no = text_no.astype(np.int64)
        total = np.bincount(text_no, minlength=n).astype(float)
        counts = np.zeros((len(self.languages), n))
        if self.languages:
            masks = self.masks(grams)
            for k in range(len(self.languages)):
                hit = ((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(bool)
                counts[k] = np.bincount(text_no[hit], minlength=n)
            fp = self.false_rate[:, None]
            counts = np.maximum(0.0, (counts - fp * total) / np.maximum(1e-9, 1 - fp))
        return counts, total

    def named(self, counts: np.ndarray, total: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of each text from its tally."""
        if not self.languages:
            return [("und", 0.0)] * len(total)
        best, sums = counts.argmax(axis=0), counts.sum(axis=0)
        out = []
        for i in range(len(total)):
            if not total[i]:
                out.append(("und", 0.0))
            elif not sums[i]:
                out.append((self.languages[self.prior], 0.0))
            else:
                out.append((self.languages[best[i]], float(counts[best[i], i] / sums[i])))
        return out

    def decide(self, texts: list[str]) -> list[tuple[str, float]]:
        return self.named(*self.tally(texts))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, profile: int = PROFILE) -> Filter:
    """Learn a filter from ``labelled`` (text, lang), a bounded sample of whole texts per language.

    A language with more than ``sample_rows`` rows is sampled by a hash of the
    text down to about that many. Trigrams seen once are left out. Rows with a
    null label or text teach nothing; no rows give a filter that answers ``und``.
    """
    rows = labelled.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Filter([], [])
    languages = sorted(sizes)
    share = F.lit(0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, sample_rows * (1 << 20) // sizes[lang]))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1 << 20)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, run in passes(texts):
                grams, text_no = trigrams(run)
                of = np.array([languages.index(x) for x in langs[start : start + len(run)]])[text_no] if len(grams) else text_no
                for k in np.unique(of):
                    g, n = np.unique(grams[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g), pa.array(n.astype(np.int64))], names=["k", "gram", "n"])

    counted = sample.mapInArrow(count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    # A language's profile is bounded before anything comes to the driver: a histogram of counts gives the cut.
    sized = counted.groupBy("k", "n").agg(F.count(F.lit(1)).alias("grams"))
    cuts: dict[int, int] = {}
    seen: dict[int, int] = {}
    totals: dict[int, int] = {}
    closed: set[int] = set()
    for r in sized.orderBy("k", F.desc("n")).collect():
        totals[r["k"]] = totals.get(r["k"], 0) + r["n"] * r["grams"]
        if r["k"] not in closed and (r["k"] not in cuts or r["n"] > 1 and seen[r["k"]] + r["grams"] <= profile):
            seen[r["k"]] = seen.get(r["k"], 0) + r["grams"]
            cuts[r["k"]] = r["n"]
        else:
            closed.add(r["k"])
    keep = F.lit(False)
    for k, cut in cuts.items():
        keep = keep | ((F.col("k") == k) & (F.col("n") >= cut))
    rate = F.lit(0.0)
    for k, total in totals.items():
        rate = F.when(F.col("k") == k, F.col("n") / F.lit(float(total))).otherwise(rate)
    got = counted.where(keep).withColumn("rate", rate).select("k", "gram", "rate").toPandas()
    top = got.groupby("gram")["rate"].transform("max") if len(got) else got["rate"]
    got = got[got["rate"] >= SHARE * top]
    profiles = [np.sort(got.loc[got["k"] == k, "gram"].to_numpy(np.int64)) for k in range(len(languages))]
    return Filter(languages, profiles, max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k)))


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (share of the corrected popcounts) to every row of ``docs``, from ``text`` alone.

    Null texts and texts without a letter get ``und`` and 0. Equal counts go to
    the language that sorts first; a text no filter knows gets the most frequent
    learned language and 0. Repeated rows each get their result. Other columns
    pass through; columns named ``lang_pred`` or ``score`` are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, float]] = []
            for _, run in passes(batch.column(at).to_pylist()):
                found += shared.value.decide(run)
            pred, score = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pred, score], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)


def held_out(doc_id) -> F.col:
    """True for the fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def predict_documents(docs: DataFrame) -> DataFrame:
    """Learn on the rows that are not held out and predict every row: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter get ``und`` and 0, as all do where
    nothing can be learned. Whole texts are read, however long; repeated rows
    are predicted each; other columns are ignored; no documents give no rows.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, known: float = KNOWN, least: int = JUDGED) -> DataFrame:
    """The documents in one learned language, with the columns they have.

    Rows that get ``und`` go (null texts, texts without a letter), and so do texts
    of at least ``least`` trigrams whose best language contains less than
    ``known`` of them: texts in languages that were not learned, in several at
    once, or in none. A row without a ``lang`` gets the predicted one. Whole
    texts are read, however long. Repeated rows stay or go together; no
    documents give no rows; other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out(F.col("doc_id")))))
    at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays: list[bool] = []
            langs: list[str] = []
            for _, run in passes(batch.column(at).to_pylist()):
                counts, total = shared.value.tally(run)
                best = counts.max(axis=0) if len(counts) else np.zeros(len(run))
                names = [lang for lang, _ in shared.value.named(counts, total)]
                stays += [lang != "und" and (n < least or b >= known * n) for lang, n, b in zip(names, total, best, strict=True)]
                langs += names
            told = pc.coalesce(batch.column(lang_at), pa.array(langs, batch.schema.field(lang_at).type))
            columns = [told if i == lang_at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
