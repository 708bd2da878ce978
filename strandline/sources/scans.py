"""Scans: positional list rows, drifting JSON, result bindings, documents as blocks, repair of paged reads."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIST_SCHEMA = "header array<string>, rows array<array<string>>"
BINDINGS_SCHEMA = "head struct<vars: array<string>>, results struct<bindings: array<map<string, struct<type: string, value: string>>>>"
BLOCKS = "array<struct<pos: int, kind: string, cls: string, text: string>>"


def positional_rows(raw: DataFrame, expected: list[str], types: dict[str, str]) -> DataFrame:
    """Rows of a list document {header, rows} as typed columns; ``pos`` keeps their order.

    The header must begin with ``expected`` (more columns at its end are allowed),
    else the scan fails. Cells that do not fit their type are null.
    """
    named = F.transform(F.sequence(F.lit(1), F.lit(len(expected))), lambda i: F.get("header", i - 1))
    checked = raw.withColumn("_ok", F.assert_true(named == F.array(*map(F.lit, expected)), F.concat(F.lit("unexpected header: "), F.array_join("header", ","))))
    cells = checked.where(F.col("_ok").isNull()).select(F.posexplode("rows").alias("pos", "cell"))
    return cells.select("pos", *[F.get("cell", F.lit(i)).try_cast(types.get(c, "string")).alias(c) for i, c in enumerate(expected)])


def rechecked(rows: DataFrame, key: dict[str, object]) -> DataFrame:
    """The rows of a read that asked for ``key``; a row of another key fails the scan.

    A source may ignore a filter it does not know: dropping such rows would make a broken read look empty.
    """
    for column, value in key.items():
        same = F.coalesce(F.col(column) == F.lit(value), F.lit(False))
        found = F.concat(F.lit(f"asked for {column} {value}, got "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
        rows = rows.withColumn(column, F.when(F.assert_true(same, found).isNull(), F.col(column)))
    return rows


def strict_json(text: Column, schema: str) -> Column:
    """JSON under a declared schema; anything else fails the scan."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def drifting(text: Column, paths: dict[str, tuple[str, str]]) -> list[Column]:
    """Fields of JSON whose shape drifts: name -> (path, type); what is absent or does not fit is null."""
    value = F.try_parse_json(text)
    return [F.try_variant_get(value, path, kind).alias(name) for name, (path, kind) in paths.items()]


def one_or_many(text: Column, path: str, item: str = "string") -> Column:
    """An array that the source writes as a bare value where there is one."""
    value = F.try_parse_json(text)
    many = F.try_variant_get(value, path, f"array<{item}>")
    one = F.try_variant_get(value, path, item)
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast(f"array<{item}>"))


def bindings(raw: DataFrame, names: list[str]) -> DataFrame:
    """One row per result binding of a query answer, a column per variable."""
    return raw.select(F.explode("results.bindings").alias("b")).select(*[F.col("b")[n]["value"].alias(n) for n in names])


def repaired(pages: DataFrame, key: str, day: str, total: int, reread) -> tuple[DataFrame, DataFrame]:
    """Records of a paged read whose pages shifted: the first of each key, plus whole days read again.

    Days with a record that came twice lost another one; ``reread(days)`` gives all
    records of a DataFrame of such days. Also returns one row (rows, missing).
    """
    others = [c for c in pages.columns if c != key]
    first = pages.groupBy(key).agg(F.min_by(F.struct(*others), F.col("pos")).alias("r")).select(key, "r.*")
    twice = pages.groupBy(key, day).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(day).distinct()
    more = reread(twice).join(first.select(key), key, "left_anti")
    every = first.unionByName(more, allowMissingColumns=True).dropDuplicates([key])
    return every, every.agg(F.count(F.lit(1)).alias("rows"), (F.lit(total) - F.count(F.lit(1))).alias("missing"))


_BLOCK = re.compile(r"(?is)<(h[1-6]|p|li|td|th)\b([^>]*)>(.*?)(?=</\1\s*>|<(?:h[1-6]|p|li|td|th)\b|\Z)")
_CLASS = re.compile(r"""(?i)class\s*=\s*["']?([^"'\s>]+)""")


def html_to_blocks(page: str | None) -> list[dict]:
    """Headings, paragraphs, list items and cells of a page in order, with their class and plain text."""
    page = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", page or "")
    out = []
    for m in _BLOCK.finditer(page):
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", m[3])).split())
        if text:
            kind = {"p": "paragraph", "li": "item", "td": "cell", "th": "cell"}.get(m[1].lower(), "heading")
            found = _CLASS.search(m[2])
            out.append({"pos": len(out), "kind": kind, "cls": found[1] if found else None, "text": text})
    return out


def html_blocks(page: Column) -> Column:
    """Blocks of HTML pages, Arrow-batched: order and nesting are beyond patterns over columns."""

    @F.pandas_udf(BLOCKS)
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(html_to_blocks)

    return run(page)


def text_chunks(lines: DataFrame, key: str, pos: str, text: str, most: int = 400) -> DataFrame:
    """Lines joined to chunks of about ``most`` characters that begin at line borders."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    cut = lines.withColumn("chunk", F.floor(F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)) / most))
    return cut.groupBy(key, "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, text))), lambda x: x[text]), "\n").alias(text))
