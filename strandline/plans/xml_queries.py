"""XML documents made of the test tables' lines, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.base import registry, table
from strandline.sources import xml_blocks

QUERIES, SQL, query = registry()

#: Each line of a document is a heading, a paragraph with a designation, an item, or a row of a table of its own, by a hash.
LINES_SQL = r"""l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS said FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, n, trim(regexp_replace(said, '\s+', ' ', 'g')) AS said, CAST('0x' || substr(md5(doc_id || ':' || n), 1, 4) AS INTEGER) AS h FROM l)"""


def xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``LINES_SQL`` as XML: doc_id, xml."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "said"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "n")), 1, 4), 16, 10).cast("int")
    escaped = F.replace(F.replace(F.replace(F.regexp_replace("said", r"[\x00-\x08\x0B-\x1F]", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = lines.select("doc_id", "n", escaped.alias("said"), h.alias("h"))
    k = F.col("h") % 4
    item = F.concat(F.lit('<liste><listelem typ="z"><gldsym>'), (F.col("h") % 9 + 1).cast("string"), F.lit(".</gldsym>"), "said", F.lit("</listelem></liste>"))
    row = F.concat(F.lit('<table><tr><td colspan="'), (F.col("h") % 2 + 1).cast("string"), F.lit('"><absatz>'), "said", F.lit("</absatz></td>"), F.when(F.col("h") % 2 == 0, "<td>new<nbsp/>text</td>").otherwise(""), F.lit('</tr><tr><td>a</td><td>b<gdash/>c</td></tr></table>'))
    shown = F.when(k == 0, F.concat(F.lit('<ueberschrift typ="g1">'), "said", F.lit("</ueberschrift>"))).when(k == 1, F.concat(F.lit('<absatz typ="abs"><gldsym>('), (F.col("h") % 9 + 1).cast("string"), F.lit(")</gldsym> "), "said", F.lit("</absatz><fzinhalt><absatz>page</absatz></fzinhalt>"))).when(k == 2, item).otherwise(row)
    listed = F.sort_array(F.collect_list(F.struct("n", shown.alias("x"))))
    return lines.groupBy("doc_id").agg(F.concat(F.lit("<doc>"), F.array_join(F.transform(listed, lambda r: r["x"]), "\n"), F.lit("</doc>")).alias("xml"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS pos, CASE h % 4 WHEN 0 THEN 'heading' WHEN 2 THEN 'item' ELSE 'paragraph' END AS kind, CASE h % 4 WHEN 0 THEN 'g1' WHEN 1 THEN 'abs' WHEN 2 THEN 'z' END AS cls,
  CASE h % 4 WHEN 1 THEN '(' || (h % 9 + 1) || ')' WHEN 2 THEN (h % 9 + 1) || '.' ELSE '' END AS designation, md5(said) AS text_md5, h % 4 = 3 AS in_table FROM h""")
def xml_block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of XML documents in reading order, without page footers."""
    found = xml_blocks.block_rows(xml_documents(spark, sf_dir), "doc_id", "xml")
    return found.select("doc_id", "pos", "kind", "cls", "designation", F.md5("text").alias("text_md5"), F.col("tbl").isNotNull().alias("in_table"))


@query(f"""WITH {LINES_SQL}, t AS (SELECT doc_id, said, h, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS tbl FROM h WHERE h % 4 = 3)
SELECT doc_id, tbl, 0 AS row, md5(said) AS current_md5, CASE WHEN h % 2 = 0 THEN md5('new text') ELSE md5(said) END AS proposed_md5 FROM t UNION ALL SELECT doc_id, tbl, 1, md5('a'), md5('b-c') FROM t""")
def xml_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of two-column tables in XML documents; a cell over both columns stands on both sides."""
    cells = xml_blocks.cell_rows(xml_documents(spark, sf_dir), "doc_id", "xml")
    found = xml_blocks.two_sides(cells, ["doc_id"])
    return found.select("doc_id", "tbl", "row", F.md5("current").alias("current_md5"), F.md5("proposed").alias("proposed_md5"))
