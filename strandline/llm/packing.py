"""Best-fit packing of tokenized documents by linear grouping.

Only the histogram of piece lengths (one row per length up to the sequence
length) comes to the driver, so planning costs the same at any corpus size.
The plan says, for each length, which run of its pieces goes to which run of
sequences at which offset; pieces are numbered per length and joined to it.

Planning: large lengths are split in groups of equal cardinality and rounded up
to their group's largest; a configuration LP over these few sizes is solved by
column generation; its whole parts are filled with actual pieces, whose true
lengths leave more room than the rounded ones; the remaining large pieces and
then the small ones go, longest first, to the fullest sequence that has room.
"""

from __future__ import annotations

import bisect
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import chunks_for, materialize, ranked

SEQUENCE = 4096
END_ID = 1
#: Pieces of at least this share of a sequence are large.
LARGE = 1 / 6
#: Sizes that large lengths are rounded up to.
GROUPS = 48
#: Rounds of column generation at most; the packing is valid after any number.
ROUNDS = 400
#: Entries that a worker's word cache holds before it starts anew.
CACHE = 400_000


class Tokens:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, the same as the tokenizer's own.

    The vocabulary's splitting rule never crosses white space, so the ids of a
    text are those of its space-separated chunks in order; chunks are cached.
    Texts with a special token's string or an information separator
    (U+001C-U+001F, white space for Python only) are encoded whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.bytes_of = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # Fixed value: the splitting pattern of the vocabulary file.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.odd = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>|[\x1c-\x1f]").search
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        shown = word if word.isascii() else self.bytes_of(word)[0][0]
        found = self.words[word] = self.pack([t.id for t in self.model.tokenize(shown)])
        return found

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            text = chunk.lower()
        elif max(chunk) < "ɐ":
            text = unicodedata.normalize("NFC", chunk).lower()
        else:
            text = ""
        if not text or "\0" in text:
            found = self.pack(self.whole.encode(chunk, add_special_tokens=False).ids)
        else:
            words = self.words
            found = b"".join([words.get(w) or self.word(w) for w in self.split(text)])
        self.chunks[chunk] = found
        return found

    def __call__(self, text: str) -> bytes:
        if self.odd(text):
            return self.pack(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        if len(self.words) > CACHE:
            self.words.clear()
        known = self.chunks
        chunks = text.split()
        found = list(map(known.get, chunks))
        if None in found:
            found = [x if x is not None else known[c] if c in known else self.chunk(c) for x, c in zip(found, chunks, strict=True)]
        return b"".join(found)


_tokens: dict[str, Tokens] = {}


def tokenizer(path: str) -> Tokens:
    """One per worker process."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Tokenize every row's text (null: empty), end it with id 1 and cut it: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = tokenizer(path or vocabulary()), 4 * sequence
        end = struct.pack("<I", END_ID)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, x in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], counts: list[int], sequence: int) -> list[tuple[list[int], float]]:
    """Solve the configuration LP: minimise sequences so that configurations hold ``counts`` of ``sizes``.

    Column generation on a basis of one column per size; a new column comes
    from an integer knapsack over the dual prices. Returns the configurations
    in use (how many of each size) and how often.
    """
    k = len(sizes)
    basis = np.diag([float(sequence // s) for s in sizes])
    inverse = np.linalg.inv(basis)
    need = np.array(counts, float)
    for turn in range(ROUNDS):
        if turn % 50 == 49:
            inverse = np.linalg.inv(basis)
        level = inverse @ need
        prices = inverse.sum(axis=0)
        # best[c]: the dearest filling of at most c tokens; each pass may add one more piece of its size.
        best, passes = np.zeros(sequence + 1), []
        for i, size in enumerate(sizes):
            for _ in range(sequence // size if prices[i] > 1e-12 else 0):
                more = best[: sequence + 1 - size] + prices[i]
                better = more > best[size:] + 1e-12
                if not better.any():
                    break
                best = np.concatenate((best[:size], np.where(better, more, best[size:])))
                passes.append((i, better))
        if best[sequence] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), sequence
        for i, better in reversed(passes):
            if c >= sizes[i] and better[c - sizes[i]]:
                column[i] += 1
                c -= sizes[i]
        direction = inverse @ column
        open_rows = np.where(direction > 1e-9)[0]
        if not len(open_rows):
            break
        leaving = open_rows[np.argmin(level[open_rows] / direction[open_rows])]
        basis[:, leaving] = column
        pivot = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, pivot)
        inverse[leaving] = pivot
    level = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(int).tolist(), float(level[j])) for j in range(k) if level[j] > 1e-9]


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first piece, number of pieces, first sequence, offset).

    Pieces of a length are numbered from 0; piece ``first + i`` of a row goes to
    sequence ``first sequence + i`` at ``offset``.
    """
    left = dict(sorted(histogram.items()))
    used = dict.fromkeys(left, 0)
    # A pile: as many sequences as `many`, all holding pieces of the lengths `held` in this order.
    piles: list[tuple[int, list[int], int]] = []

    large = [(length, n) for length, n in left.items() if LARGE * sequence <= length <= sequence]
    total = sum(n for _, n in large)
    if total:
        # A length as frequent as a group is a group of its own, which rounds nothing.
        share, sizes, counts, open_places = -(-total // GROUPS), [], [], 0
        members: list[list[list[int]]] = []
        for length, n in reversed(large):
            if n >= share:
                sizes.append(length)
                counts.append(n)
                members.append([[length, n]])
                n = open_places = 0
            while n:
                if not open_places:
                    sizes.append(length)
                    counts.append(0)
                    members.append([])
                    open_places = share
                take = min(n, open_places)
                counts[-1] += take
                members[-1].append([length, take])
                open_places, n = open_places - take, n - take
        # Groups that begin at the same length are one size.
        for i in range(len(sizes) - 1, 0, -1):
            if sizes[i] == sizes[i - 1]:
                counts[i - 1] += counts.pop(i)
                members[i - 1] += members.pop(i)
                sizes.pop(i)
        for config, level in configurations(sizes, counts, sequence):
            many = int(level + 1e-6)
            for i, k in enumerate(config):
                if k:
                    many = min(many, sum(n for _, n in members[i]) // k)
            if many < 1:
                continue
            # Substitute actual pieces: each slot takes a run of its group; cut the pile where a slot's true length changes.
            slots = []
            for i, k in enumerate(config):
                for _ in range(k):
                    need, runs = many, []
                    while need:
                        length, n = members[i][0]
                        take = min(need, n)
                        runs.append((length, take))
                        need -= take
                        members[i][0][1] -= take
                        if not members[i][0][1]:
                            members[i].pop(0)
                    slots.append(runs)
            cuts = sorted({sum(n for _, n in runs[: j + 1]) for runs in slots for j in range(len(runs))})
            for begin, end in zip([0, *cuts], cuts, strict=False):
                held = []
                for runs in slots:
                    at = 0
                    for length, n in runs:
                        if at <= begin < at + n:
                            held.append(length)
                        at += n
                piles.append((end - begin, held, sequence - sum(held)))
        for many, held, _ in piles:
            for length in held:
                left[length] -= many

    # Best fit, longest first, on piles: by room, then in order of creation.
    room: list[tuple[int, int]] = sorted((r, i) for i, (_, _, r) in enumerate(piles))
    made = dict(enumerate(piles))
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(room, (length, -1))
            if at == len(room):
                fits = sequence // length
                for k, many in ((fits, n // fits), (n % fits, 1)):
                    if k and many:
                        made[len(made)] = (many, [length] * k, sequence - k * length)
                        bisect.insort(room, (sequence - k * length, len(made) - 1))
                break
            _, i = room.pop(at)
            many, held, r = made[i]
            k = min(r // length, -(-n // many) if n >= many else 1)
            if n >= many:
                k = min(r // length, n // many)
                made[i] = (many, held + [length] * k, r - k * length)
                n -= k * many
            else:
                # Fewer pieces than sequences: fill some of them as far as they go, keep the others apart.
                k = min(r // length, n)
                full = n // k
                made[i] = (full, held + [length] * k, r - k * length)
                made[len(made)] = (many - full, held, r)
                bisect.insort(room, (r, len(made) - 1))
                n -= full * k
            bisect.insort(room, (made[i][2], i))

    rows, first = [], 0
    for i in sorted(made):
        many, held, _ = made[i]
        offset = 0
        for length in held:
            rows.append((length, used[length], many, first, offset))
            used[length] += many
            offset += length
        first += many
    return rows


def place(cut: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` from 1 to ``sequence``; no row is lost or cut."""
    spark: SparkSession = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(histogram, sequence)
    where = spark.createDataFrame(rows, "length long, first long, many long, first_sequence long, offset long")
    # A piece finds its run through the block of BLOCK numbers that both touch.
    block = max(1, sum(histogram.values()) // max(1, len(rows)))
    where = where.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("many") - 1) / block))))
    number = ranked(cut, ["length"], F.xxhash64("doc_id", "piece"), [F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32"], chunks_for(max(histogram.values(), default=1)), "number")
    number = number.withColumn("block", F.floor(F.col("number") / block))
    joined = number.join(where, ["length", "block"]).where("number >= first AND number < first + many")
    return joined.select(*cut.columns, (F.col("first_sequence") + F.col("number") - F.col("first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of at most ``sequence`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, one
    row per piece. Null and empty texts are a piece of the end id alone.
    Repeated rows are packed each. No documents give no rows.
    """
    return place(materialize(pieces(docs, path, sequence), "pieces"), sequence)
