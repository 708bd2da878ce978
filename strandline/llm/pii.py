"""Personal data: base patterns, and a linear-chain conditional random field.

The base rules are exact patterns. The field adds spans that they leave open
(numbers without a country code, two card numbers side by side, dashed or dotted
groups). It labels every word that holds a digit or an at sign and the
``CONTEXT`` words on either side; words further off are outside by definition,
which cuts a text into independent chains. Its features are word shapes and
checks of the word, and shapes and wording of its neighbours, so that a bare
number after "call" and one after "order" differ. Its weights are fitted to a
small labelled table by maximum likelihood, and chains are decoded by Viterbi,
all chains of a batch at once in numpy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Labelled rows that a fit takes at most.
TABLE_ROWS = 2000
#: Words on either side of a candidate that belong to its chain.
CONTEXT = 3
#: Words up to this length are remembered with their features.
REMEMBERED = 64

# Patterns as specified; lookbehinds and possessive repeats only save time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Characters that an added span begins and ends with.
_ENDS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign outwards: its local part is the whole run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base matches, sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(found)


# The field.


def shapes_of(word: str) -> tuple[str, ...]:
    """Shape features of one whole word: its pattern with run lengths, and checks on its digits; its lower-case form if it has none."""
    core = word.strip(".,;:!?\"'<>[]{}#*$%&|")
    if not ("@" in core or _DIGIT.search(core)):
        return (f"word={core.lower()}" if len(core) <= REMEMBERED else "word",)
    runs: list[list] = []
    for c in core:
        k = "d" if c in "0123456789" else "X" if c.isupper() else "x" if c.isalpha() else c
        if runs and runs[-1][0] == k and k in "dXx":
            runs[-1][1] += 1
        else:
            runs.append([k, 1])
    pattern = "".join(f"{k}{n if n < 20 else '+'}" if k == "d" else k for k, n in runs)
    digits = re.sub(r"[^0-9]", "", core)
    out = [f"shape={pattern}", f"digits={min(len(digits), 20)}", f"kinds={''.join(sorted({k for k, _ in runs}))}"]
    if "@" in core and not core.startswith("@") and "." in core.partition("@")[2]:
        out.append("mail")
    parts = core.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        out.append("quad")
    if 12 <= len(digits) <= 19 and len(digits) == len(re.sub(r"[ -]", "", core)):
        out.append(f"luhn={luhn(digits)}")
    if core.startswith(("+", "(")):
        out.append(f"open={core[0]}")
    return tuple(out)


_remembered = lru_cache(maxsize=100_000)(shapes_of)


def shapes(word: str) -> tuple[str, ...]:
    """``shapes_of``; only words up to ``REMEMBERED`` characters are kept in memory."""
    return _remembered(word) if len(word) <= REMEMBERED else shapes_of(word)


def features(words: list[str]) -> list[list[str]]:
    """The features of each word of a chain: its own, and the first one of up to two words before and one after."""
    first = ["edge", "edge", *(shapes(w)[0] for w in words), "edge"]
    return [["bias", *shapes(w), f"left2:{first[i]}", f"left:{first[i + 1]}", f"right:{first[i + 3]}"] for i, w in enumerate(words)]


def chains_of(text: str) -> list[list[tuple[int, int]]]:
    """The chains of a text as lists of word ranges: words with a digit or an at sign and ``CONTEXT`` words around, merged where they touch."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    out: list[list[tuple[int, int]]] = []
    before: list[tuple[int, int]] = []
    wanted = 0
    for m in _WORD.finditer(text):
        if "@" in m[0] or _DIGIT.search(m[0]):
            if not wanted:
                # Up to CONTEXT words that stand before; those of the last chain stay with it.
                out.append(before)
                before = []
            out[-1].append(m.span())
            wanted = CONTEXT + 1
        elif wanted:
            out[-1].append(m.span())
        else:
            before = [*before[1 - CONTEXT :], m.span()] if CONTEXT > 1 else [m.span()]
        wanted = max(0, wanted - 1)
    return out


class Field:
    """Weights of a linear-chain CRF over string features."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, run: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(run), len(LABELS)))
        for t, names in enumerate(run):
            for name in names:
                k = self.index.get(name)
                if k is not None:
                    out[t] += self.emit[k]
        return out

    def decode(self, runs: list[list[list[str]]]) -> list[np.ndarray]:
        """The best label sequence of each run; runs of like length are decoded together."""
        found: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        begin = 0
        while begin < len(order):
            longest = max(4, 2 * len(runs[order[begin]]))
            end = begin
            while end < len(order) and len(runs[order[end]]) <= longest and end - begin < 4096:
                end += 1
            group = order[begin:end]
            length = max(len(runs[i]) for i in group)
            pad = np.zeros((len(group), length, len(LABELS)))
            size = np.array([len(runs[i]) for i in group])
            for row, i in enumerate(group):
                pad[row, : len(runs[i])] = self.scores(runs[i])
            best, back = pad[:, 0] + START, np.zeros((len(group), length, len(LABELS)), np.int8)
            for t in range(1, length):
                ways = best[:, :, None] + self.move[None] + FORBIDDEN[None]
                back[:, t] = ways.argmax(axis=1)
                step = ways.max(axis=1) + pad[:, t]
                best = np.where((t < size)[:, None], step, best)
            last = best.argmax(axis=1)
            for row, i in enumerate(group):
                path = np.zeros(size[row], int)
                path[-1] = last[row]
                for t in range(size[row] - 1, 0, -1):
                    path[t - 1] = back[row, t, path[t]]
                found[i] = path
            begin = end
        return found


#: I-x follows B-x or I-x only, and never opens a run.
FORBIDDEN = np.array([[-1e6 if b[0] == "I" and a[1:] != b[1:] else 0.0 for b in LABELS] for a in LABELS])
START = np.array([-1e6 if b[0] == "I" else 0.0 for b in LABELS])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Examples:
    """Labelled chains as arrays: feature numbers of each word (padded with the last number, which weighs nothing), labels, lengths."""

    def __init__(self, chains: list[list[list[str]]], gold: list[list[int]]):
        self.index = {name: i for i, name in enumerate(sorted({f for chain in chains for t in chain for f in t}))}
        n, length = len(chains), max(map(len, chains), default=1)
        most = max((len(t) for chain in chains for t in chain), default=1)
        ids = np.full((n, length, most), len(self.index))
        self.y, size = np.zeros((n, length), int), np.array([len(c) for c in chains], int)
        for i, chain in enumerate(chains):
            for t, names in enumerate(chain):
                ids[i, t, : len(names)] = [self.index[f] for f in names]
                self.y[i, t] = gold[i][t]
        self.inside = np.arange(length)[None] < size[:, None]
        self.ids = ids[self.inside]

    def spread(self, weight: np.ndarray) -> np.ndarray:
        """Sums of per-word label weights by feature."""
        k = len(LABELS)
        many = self.ids.shape[1]
        return np.stack([np.bincount(self.ids.ravel(), np.repeat(weight[:, j], many), len(self.index) + 1)[:-1] for j in range(k)], axis=1)

    def likelihood(self, emit: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of all chains and its slopes, by the forward and backward recursions."""
        n, length = self.inside.shape
        k = len(LABELS)
        inside, y = self.inside, self.y
        score = np.zeros((n, length, k))
        score[inside] = np.vstack([emit, np.zeros(k)])[self.ids].sum(axis=1)
        step = move + FORBIDDEN
        ahead = np.zeros((n, length, k))
        ahead[:, 0] = score[:, 0] + START
        for t in range(1, length):
            ahead[:, t] = np.where(inside[:, t, None], log_sum(ahead[:, t - 1][:, :, None] + step, 1) + score[:, t], ahead[:, t - 1])
        whole = log_sum(ahead[:, -1], 1)
        behind = np.zeros((n, length, k))
        got_move = np.zeros((k, k))
        for t in range(length - 2, -1, -1):
            following = score[:, t + 1] + behind[:, t + 1]
            there = inside[:, t + 1]
            behind[:, t] = np.where(there[:, None], log_sum(step + following[:, None, :], 2), 0)
            p = np.exp(ahead[:, t][:, :, None] + step + following[:, None, :] - whole[:, None, None])
            got_move += p[there].sum(axis=0)
        chance = np.exp(ahead + behind - whole[:, None, None])
        want = np.eye(k)[y[inside]]
        want_move = np.zeros((k, k))
        pairs = inside[:, 1:]
        np.add.at(want_move, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        value = float((score[inside] * want).sum() + (step * want_move).sum() - whole.sum()) if n else 0.0
        return value, self.spread(want - chance[inside]), want_move - got_move


def examples(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> Examples:
    """The chains of labelled rows; a word takes the label of the first span that it touches."""
    chains, gold = [], []
    for text, spans in rows[:TABLE_ROWS]:
        for chain in chains_of(text):
            labels, inside = [], None
            for a, b in chain:
                span = next((s for s in spans if s[1] < b and a < s[2]), None)
                labels.append(0 if span is None else LABELS.index(("I-" if span == inside else "B-") + span[0]))
                inside = span
            chains.append(features([text[a:b] for a, b in chain]))
            gold.append(labels)
    return Examples(chains, gold)


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 80, penalty: float = 0.02, rate: float = 0.2) -> Field:
    """Maximum likelihood with an L2 penalty by full-batch Adam on the chains of the labelled rows; deterministic."""
    data = examples(rows)
    weights = [np.zeros((len(data.index), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))]
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for turn in range(1, rounds + 1):
        _, *slopes = data.likelihood(*weights)
        for w, slope, (m, v) in zip(weights, slopes, state, strict=True):
            slope = slope - penalty * w
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            w += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(data.index, *weights)


def labelled_table(copies: int = 9, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table: sentences by template with invented values, and their spans (kind, start, end).

    In a template, ``{kind}`` stands for a labelled value, ``{bare}`` for a phone
    number of digits alone, ``{no}`` and ``{loose}`` for numbers that are none, ``{w}``
    for an invented word; in a form, 9 is any digit, ``?`` any letters.
    """
    rng = np.random.default_rng(seed)
    forms = {
        "phone": ["+9 (999) 999-9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "+99 999 999 9999", "+99 9999 999999", "099 9999 9999", "+9 999 999 9999"],
        "ip": ["A.A.A.A"],
        "card": ["L", "L4", "L-"],
        "email": ["??.??@??.example.com", "???99@??99.example.org", "??@???.net", "??-??@??-??.example"],
        # The same bare digits mean a phone number after some words and nothing after others.
        "bare": ["9999999999", "999999999", "99999999999"],
        "loose": ["9999999999", "999999999", "99999999999"],
        "no": ["9", "99", "1999", "20999", "9.9", "v9.9.9", "9.9.9", "99%", "2099-09-09", "99:99", "$99.99", "99,999", "(9)", "[99]", "999999", "?9?99?999??9", "9th", "N", "§9", "9-9", "99/99/2099", "token=?9?9?9?9?9?9?9", "@????", "999-999", "99999-9999", "?????99", "9)", "99.", "N9", "999 999"],
    }

    def number(n: int) -> str:
        return "".join(str(d) for d in rng.integers(0, 10, n))

    def value(kind: str) -> str:
        if kind == "w":
            return "".join(chr(97 + x) for x in rng.integers(0, 26, 2 + rng.integers(8))) + str(rng.choice(["", "", "", ",", "."]))
        form = forms[kind][rng.integers(len(forms[kind]))]
        if form[0] in "LN":
            n = int(rng.choice([13, 15, 16, 16, 16]))
            head = "4" + number(n - 2)
            check = next(c for c in "0123456789" if luhn(head + c))
            digits = head + (check if form[0] == "L" else str((int(check) + 1 + rng.integers(9)) % 10))
            cut = form[1:] if n == 16 else ""
            return digits if not cut or cut == "9" else (" " if cut == "4" else "-").join(digits[i : i + 4] for i in range(0, 16, 4))
        out = []
        for c in form:
            out.append(number(1) if c == "9" else str(rng.integers(0, 256)) if c == "A" else "".join(chr(97 + x) for x in rng.integers(0, 26, 1 + rng.integers(5))) if c == "?" else c)
        return "".join(out)

    templates = [
        "please call {phone} today", "call {bare} now", "you can reach us on {phone}", "phone {bare}", "tel. {phone}, or {phone}", "mobile: {bare}", "ring {no} or {phone}.", "fax {phone} {w}", "{w} {w} {phone} {w} {w}", "{phone}",
        "order {loose} of {w}", "invoice {loose} is due", "id {loose}", "no. {loose} {w}", "sku {loose} {w} {w}", "{w} {w} {loose} {w}", "{w} {loose}, {w}",
        "from {ip} at {no}", "host {ip}", "{w} {ip} {no} {w}", "{w} {w} {ip}", "login from {ip} failed",
        "card {card} due {no}", "{card} {card}", "{w} {w} {card} {w}", "pay with {card}.", "{w} {card} {phone} {w}", "the number {card} {w}",
        "write to {email}, please", "{w} {email} {w}", "<{email}> wrote", "{email} {phone} {card}", "mail {email}",
        "in {no} there were {no} of them", "{no} {no}", "see {no}", "{w} {no} {no} {w}", "about {no}, {no} and", "id {no} from {ip}", "version {no} of {no}", "{w} {w} {no} {w} {w}", "{no} {card}", "{phone} {no}", "token = {no} {w}",
    ]
    rows = []
    for _ in range(copies):
        for template in templates:
            text, spans = "", []
            for piece in re.split(r"(\{[a-z]+\})", template):
                if piece.startswith("{"):
                    kind, shown = piece[1:-1], value(piece[1:-1])
                    if kind not in ("no", "loose", "w"):
                        spans.append(("phone" if kind == "bare" else kind, len(text), len(text) + len(shown)))
                    text += shown
                else:
                    text += piece
            rows.append((text, spans))
    return rows


def plausible(kind: str, shown: str) -> bool:
    """Whether a labelled stretch can be what its label says: its count of digits, or an at sign within."""
    digits = re.sub(r"[^0-9]", "", shown)
    if kind == "email":
        return bool(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.", shown))
    if kind == "ip":
        return len(shown.split(".")) == 4
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans the field finds that overlap no base span, by text."""
    where, runs = [], []
    for i, text in enumerate(texts):
        for run in chains_of(text):
            where.append((i, run))
            runs.append(features([text[a:b] for a, b in run]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, run), path in zip(where, field.decode(runs), strict=True):
        t = 0
        while t < len(path):
            label = LABELS[path[t]]
            end = t + 1
            if label == "O":
                t = end
                continue
            while end < len(path) and LABELS[path[end]] == f"I-{label[2:]}":
                end += 1
            kind, text = label[2:], texts[i]
            a, b = run[t][0], run[end - 1][1]
            while a < b and not (text[a] in _ENDS or kind == "phone" and text[a] in "+("):
                a += 1
            while b > a and text[b - 1] not in _ENDS:
                b -= 1
            if a < b and plausible(kind, text[a:b]) and not any(s < b and a < e for s, _, e in base[i]):
                out[i].append((a, KINDS.index(kind), b))
            t = end
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return fit(labelled_table())


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, table: list[tuple[str, list[tuple[str, int, int]]]] | None = None) -> DataFrame:
    """Personal data in every row's whole text (null: empty).

    Returns doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans
    (base and added, ``kind:start:end`` in code points), n_added. The field is
    fitted on the driver to ``table`` (``TABLE_ROWS`` rows at most; default
    ``labelled_table()``). Added spans never overlap base ones. Texts are searched
    whole, however long; repeated rows are searched each; no documents give no
    rows; other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(default_field() if table is None else fit(table))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, field.value)
            counts = [pa.array([sum(k == n for _, k, _ in spans) for spans in base], pa.int64()) for n in range(4)]
            digest = pa.array([hashlib.sha256(shown(spans).encode()).hexdigest() for spans in base], pa.string())
            every = pa.array([shown(sorted(spans + more)) for spans, more in zip(base, added, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, every, pa.array([len(x) for x in added], pa.int64())], names=names)

    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
