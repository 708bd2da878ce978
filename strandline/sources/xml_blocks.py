"""XML documents as blocks in reading order, and their tables as grids, by one pass over parser events.

Order and mixed content matter, which a schema over elements does not keep; so a
document is read event by event, in Arrow batches. A document is a row, as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Elements that are blocks and their kinds, elements without text of the law, and elements that stand for a character.
KINDS = {"ueberschrift": "heading", "absatz": "paragraph", "listelem": "item", "schlussteil": "closing"}
SKIPPED = ("kzinhalt", "fzinhalt", "layoutdaten")
SIGNS = {"nbsp": " ", "gdash": "-", "br": " ", "tab": " "}
DESIGNATION = "gldsym"

BLOCK = "pos: int, kind: string, cls: string, designation: string, text: string, tbl: int"
CELL = "tbl: int, inside: int, row: int, col: int, rows: int, cols: int, text: string"
BLOCKS, CELLS = f"array<struct<{BLOCK}>>", f"array<struct<{CELL}>>"
#: Rows that are sent on together.
AT_ONCE = 2000


class Reader:
    """Blocks and cells of one document; ``broken`` if it is not well-formed."""

    def __init__(self, document: str | None):
        self.blocks: list[dict] = []
        self.cells: list[dict] = []
        self.open: list[dict] = []
        self.tables: list[dict] = []
        self.tables_seen = self.skipping = 0
        self.designated = False
        self.broken = document is None
        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.text
        parser.buffer_text = True
        try:
            parser.Parse((document or "<none/>").encode(), True)
        except expat.ExpatError:
            self.broken = True

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in SKIPPED:
            self.skipping += 1
        if self.skipping:
            return
        if tag in KINDS:
            block = {"pos": len(self.blocks), "kind": KINDS[tag], "cls": attributes.get("typ"), "designation": "", "text": "", "tbl": self.tables[-1]["no"] if self.tables else None}
            self.blocks.append(block)
            self.open.append({"tag": tag, "into": block})
        elif tag == "table":
            self.tables.append({"no": self.tables_seen, "inside": self.tables[-1]["no"] if self.tables else None, "row": -1, "held": set()})
            self.tables_seen += 1
        elif tag == "tr" and self.tables:
            self.tables[-1]["row"] += 1
        elif tag in ("td", "th") and self.tables:
            table, spans = self.tables[-1], []
            for name in ("rowspan", "colspan"):
                said = attributes.get(name, "1")
                spans.append(max(1, int(said)) if said.isdigit() else 1)
            row, col = max(0, table["row"]), 0
            while (row, col) in table["held"]:
                col += 1
            table["held"] |= {(row + r, col + c) for r in range(spans[0]) for c in range(spans[1])}
            cell = {"tbl": table["no"], "inside": table["inside"], "row": row, "col": col, "rows": spans[0], "cols": spans[1], "text": ""}
            self.cells.append(cell)
            self.open.append({"tag": tag, "into": cell})
        elif tag == DESIGNATION:
            self.designated = True
        elif tag in SIGNS:
            self.text(SIGNS[tag])

    def end(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipping -= 1
            return
        if self.skipping:
            return
        if self.open and self.open[-1]["tag"] == tag:
            self.open.pop()
            # What stands behind an inner block does not run into what stood before it.
            if self.open:
                self.open[-1]["into"]["text"] += " "
        elif tag == "table" and self.tables:
            self.tables.pop()
        elif tag == DESIGNATION:
            self.designated = False

    def text(self, said: str) -> None:
        if self.skipping or not self.open:
            return
        into = self.open[-1]["into"]
        if self.designated and "designation" in into:
            into["designation"] += said
            return
        into["text"] += said
        # A block in a cell is the cell's text as well.
        for outer in reversed(self.open[:-1]):
            if "row" in outer["into"] and "row" not in into:
                outer["into"]["text"] += said
                break


def tidied(found: list[dict]) -> list[dict]:
    return [{k: " ".join(v.split()) if isinstance(v, str) and k != "cls" else v for k, v in x.items()} for x in found]


def blocks_of(document: str | None) -> list[dict] | None:
    """The blocks of a document in the order in which they begin; null for a broken one."""
    reader = Reader(document)
    return None if reader.broken else tidied(reader.blocks)


def cells_of(document: str | None) -> list[dict] | None:
    """The cells of a document's tables with their place in the grid: spans push later cells aside, a table in a cell is a grid of its own."""
    reader = Reader(document)
    return None if reader.broken else tidied(reader.cells)


def xml_blocks(document: Column) -> Column:
    @F.pandas_udf(BLOCKS)
    def run(documents: pd.Series) -> pd.Series:
        return documents.map(blocks_of)

    return run(document)


def xml_cells(document: Column) -> Column:
    @F.pandas_udf(CELLS)
    def run(documents: pd.Series) -> pd.Series:
        return documents.map(cells_of)

    return run(document)


def _rows(documents: DataFrame, key: str, xml: str, read: Callable[[str | None], list[dict] | None], fields: str) -> DataFrame:
    """A row per found item: key and ``fields``. A task holds the rows of ``AT_ONCE`` items and one document more, not those of an Arrow batch of documents."""
    schema = T.StructType([documents.schema[key], *T.StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for k, document in zip(batch.column(0), batch.column(1), strict=True):
                named = {key: k.as_py()}
                rows += [named | item for item in read(document.as_py()) or []]
                while len(rows) >= AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows[:AT_ONCE], schema=arrow)
                    rows = rows[AT_ONCE:]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return documents.select(key, xml).mapInArrow(run, schema)


def block_rows(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """The blocks of documents (key, xml): key, pos, kind, cls, designation, text, tbl; none of a broken one."""
    return _rows(documents, key, xml, blocks_of, BLOCK)


def cell_rows(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """The table cells of documents (key, xml): key, tbl, inside, row, col, rows, cols, text; none of a broken one."""
    return _rows(documents, key, xml, cells_of, CELL)


def two_sides(cells: DataFrame, key: list[str]) -> DataFrame:
    """Rows of tables of two columns: key, tbl, row, current, proposed. A cell over both columns, or over several rows, stands on each side and in each row."""
    width = cells.groupBy(*key, "tbl").agg(F.max(F.col("col") + F.col("cols")).alias("_w")).where("_w = 2").drop("_w")
    spread = cells.join(width, [*key, "tbl"]).withColumn("row", F.explode(F.sequence("row", F.col("row") + F.col("rows") - 1)))
    side = lambda i: F.max(F.when((F.col("col") <= i) & (F.col("col") + F.col("cols") > i), F.col("text")))
    return spread.groupBy(*key, "tbl", "row").agg(side(0).alias("current"), side(1).alias("proposed"))
