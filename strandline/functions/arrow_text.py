"""Text functions beyond built-in expressions, as Arrow-batched functions: normal forms, offsets, sentences, XML tables."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ["Abs", "Art", "bzw", "ca", "d.h", "Dr", "e.g", "etc", "i.e", "Mag", "Mr", "Mrs", "Nr", "Prof", "usw", "vgl", "z.B", "Z"]
_END = re.compile(r"[.!?]+[\"'”»)]*\s+(?=[\"'„«(]?[A-ZÄÖÜÀ-Ý0-9§])")
_TAIL = re.compile(r"(?:^|[\s(])([\w.]+)$")


def nfc(text: Column) -> Column:
    """Unicode normal form C."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return run(text)


def without_marks(text: Column) -> Column:
    """Normal form D without combining marks."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))

    return run(text)


def ranges_of(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Merged [start, end) ranges in the original text of all hits of the words, whatever case or marks they stand in."""
    folded, origin = [], []
    for i, c in enumerate(text):
        for d in unicodedata.normalize("NFD", c.lower()):
            if not unicodedata.combining(d):
                folded.append(d)
                origin.append(i)
    flat = "".join(folded)
    found = []
    for word in words:
        plain = "".join(d for d in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(d))
        at = flat.find(plain) if plain else -1
        while at >= 0:
            found.append((origin[at], origin[at + len(plain) - 1] + 1))
            at = flat.find(plain, at + 1)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def match_ranges(text: Column, words: list[str]) -> Column:
    """Array of (begin, finish) of ``ranges_of``."""

    @F.pandas_udf("array<struct<begin: int, finish: int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"begin": a, "finish": b} for a, b in ranges_of(x or "", words)])

    return run(text)


def sentences_of(text: str) -> list[str]:
    """Sentences of a text; a full stop after an abbreviation, an initial or a number before a small letter ends none."""
    out, begin = [], 0
    for m in _END.finditer(text):
        before = _TAIL.search(text[begin : m.start()])
        word = before[1] if before else ""
        if m[0].startswith(".") and (word in ABBREVIATIONS or len(word) == 1 and word.isalpha() or word.isdigit()):
            continue
        out.append(text[begin : m.end()].strip())
        begin = m.end()
    return [s for s in [*out, text[begin:].strip()] if s]


def sentences(text: Column) -> Column:
    """Array of ``sentences_of``."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sentences_of(x or ""))

    return run(text)


def quote_around(text: Column, core: str, most: int = 300) -> Column:
    """The sentence that holds the core, cut to ``most`` characters; null without one."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            found = next((q for q in sentences_of(x or "") if core.lower() in q.lower()), None)
            return found if found is None or len(found) <= most else found[: most - 1].rstrip() + "…"

        return s.map(one)

    return run(text)


def table_rows(document: str | None) -> list[dict]:
    """Rows of all two-column tables of an XML text; a cell over both columns stands on both sides. Broken XML has none."""
    try:
        root = ET.fromstring(document or "<none/>")
    except ET.ParseError:
        return []
    out = []
    for row in root.iter("tr"):
        sides: list[str] = []
        for cell in row:
            if cell.tag in ("td", "th"):
                sides += [" ".join("".join(cell.itertext()).split())] * int(cell.get("colspan", "1"))
        if len(sides) == 2:
            out.append({"pos": len(out), "current": sides[0], "proposed": sides[1]})
    return out


def xml_table(document: Column) -> Column:
    """Array of ``table_rows``."""

    @F.pandas_udf("array<struct<pos: int, current: string, proposed: string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(table_rows)

    return run(document)
