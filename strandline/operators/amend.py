"""Amending instructions: a small grammar, application to a tree of paths, and a gate over the results.

A document is a set of rows (path, text) where a path such as ``3/2/1`` names a
node below its parents; rows replace recursive types. Instructions are lines of
text. What the grammar does not know is refused with a reason, never guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATION = "struct<kind: string, target: string, old: string, new: string, refusal: string>"
_PATH = r"(\d+[a-z]*(?:/\d+[a-z]*)*)"
_GRAMMAR = [
    ("replace", re.compile(rf'^In {_PATH} replace the text by "(.*)"\.?$'), lambda m: (m[1], None, m[2])),
    ("replacePhrase", re.compile(rf'^In {_PATH} replace "(.+)" by "(.*)"\.?$'), lambda m: (m[1], m[2], m[3])),
    ("insertPhrase", re.compile(rf'^In {_PATH} insert "(.+)" after "(.+)"\.?$'), lambda m: (m[1], m[3], m[2])),
    ("deletePhrase", re.compile(rf'^In {_PATH} delete "(.+)"\.?$'), lambda m: (m[1], m[2], None)),
    ("insertAfter", re.compile(rf'^After {_PATH} insert {_PATH}: "(.*)"\.?$'), lambda m: (m[1], m[2], m[3])),
    ("append", re.compile(rf'^To {_PATH} append {_PATH}: "(.*)"\.?$'), lambda m: (m[1], m[2], m[3])),
    ("renumber", re.compile(rf"^Renumber {_PATH} as {_PATH}\.?$"), lambda m: (m[1], m[2], None)),
    ("delete", re.compile(rf"^Delete {_PATH}\.?$"), lambda m: (m[1], None, None)),
]


def parse(line: str) -> dict:
    """One operation, or a refusal."""
    for kind, pattern, parts in _GRAMMAR:
        m = pattern.match((line or "").strip())
        if m:
            target, old, new = parts(m)
            return {"kind": kind, "target": target, "old": old, "new": new, "refusal": None}
    return {"kind": "refused", "target": None, "old": None, "new": None, "refusal": "not understood" if (line or "").strip() else "empty"}


def operations(line: Column) -> Column:
    """Operations of a column of instruction lines."""

    @F.pandas_udf(OPERATION)
    def run(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x) for x in lines], columns=["kind", "target", "old", "new", "refusal"])

    return run(line)


def natural(path: str) -> list:
    return [(int(re.match(r"\d+", part)[0]), part) for part in path.split("/")]


def apply(tree: dict[str, str], ops: list[dict]) -> tuple[dict[str, str], list[str | None]]:
    """The tree after all operations in order; per operation None or why it was refused. A refused one changes nothing."""
    tree, verdicts = dict(tree), []
    for op in ops:
        kind, target, old, new = op["kind"], op["target"], op["old"], op["new"]
        below = [p for p in tree if p == target or target and p.startswith(f"{target}/")]
        why = None
        if kind == "refused":
            why = op["refusal"]
        elif target not in tree and kind not in ("append",):
            why = "no such place"
        elif kind in ("replacePhrase", "insertPhrase", "deletePhrase") and tree[target].count(old) != 1:
            why = "phrase absent" if old not in tree[target] else "phrase ambiguous"
        elif kind in ("insertAfter", "append", "renumber") and old in tree:
            why = "place taken"
        elif kind == "append" and target not in tree and not below:
            why = "no such place"
        if why is None:
            if kind == "replace":
                tree[target] = new
            elif kind == "replacePhrase":
                tree[target] = tree[target].replace(old, new)
            elif kind == "insertPhrase":
                tree[target] = tree[target].replace(old, f"{old} {new}")
            elif kind == "deletePhrase":
                tree[target] = " ".join(tree[target].replace(old, "").split())
            elif kind in ("insertAfter", "append"):
                tree[old] = new
            elif kind == "delete":
                for p in below:
                    del tree[p]
            elif kind == "renumber":
                for p in below:
                    tree[old + p[len(target) :]] = tree.pop(p)
        verdicts.append(why)
    return tree, verdicts


def apply_instructions(trees: DataFrame, instructions: DataFrame, key: str) -> DataFrame:
    """Apply (key, pos, line) to (key, path, text): the new rows with ``state`` applied, and a row of state refused per refused line.

    One document's instructions are a sequential fold, so a document is a group.
    """
    kind = trees.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, nodes, lines in zip(batch[key], batch["_tree"], batch["_lines"], strict=True):
                todo = [x["line"] for x in lines]
                after, verdicts = apply({x["path"]: x["text"] for x in nodes}, [parse(x) for x in todo])
                rows += [(k, p, after[p], "applied", None) for p in sorted(after, key=natural)]
                rows += [(k, None, line, "refused", why) for line, why in zip(todo, verdicts, strict=True) if why]
            yield pd.DataFrame(rows, columns=[key, "path", "text", "state", "reason"])

    # A document is a row of arrays, and many are handed over at a time; a frame for each costs more than its fold.
    node, line = trees.select(key, F.struct("path", "text").alias("_node"), F.lit(None).alias("_line")), instructions.select(key, F.lit(None).alias("_node"), F.struct("pos", "line").alias("_line"))
    both = node.unionByName(line).groupBy(key).agg(F.collect_list("_node").alias("_tree"), F.array_sort(F.collect_list("_line")).alias("_lines"))
    return both.mapInPandas(run, f"{key} {kind}, path string, text string, state string, reason string")


def plausible(before: Column, after: Column, added: Column, gone: Column, tolerance: int = 4) -> Column:
    """Whether a result's size in words is what the instructions explain."""
    return F.abs(after - (before + added - gone)) <= tolerance


def gate(refused: Column, is_plausible: Column, oracle: Column) -> Column:
    """show, or why a result is withheld; causes in order: refused, implausible, then what the second source says.

    ``oracle``: confirmed, contradicted, foreign, silent, or null where there is no second source.
    """
    return F.when(refused, "withheld: refused").when(~F.coalesce(is_plausible, F.lit(False)), "withheld: implausible").when(oracle == "confirmed", "show").when(oracle.isNull(), "withheld: no source").otherwise(F.concat(F.lit("withheld: "), oracle))


def oracle(shown: Column, expected: Column) -> Column:
    """What a second source says of a result: confirmed, contradicted, silent (it has no text), foreign (no word in common)."""
    a, b = F.split(F.trim(shown), r"\s+"), F.split(F.trim(expected), r"\s+")
    return F.when(expected.isNull(), F.lit(None).cast("string")).when(F.trim(expected) == "", "silent").when(F.trim(shown) == F.trim(expected), "confirmed").when(F.size(F.array_intersect(a, b)) == 0, "foreign").otherwise("contradicted")
