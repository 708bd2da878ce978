"""XML blocks and grids on documents with nested tables, spans and broken ends."""

from pyspark.sql import functions as F

from strandline.sources import xml_blocks

DOCUMENT = """<doc><layoutdaten><absatz>no</absatz></layoutdaten><ueberschrift typ="art">Artikel<br/>1</ueberschrift><absatz typ="abs"><gldsym>(1)</gldsym>One &amp; two<nbsp/>three<absatz>inner</absatz>behind</absatz>
<table><tr><td rowspan="2">left</td><td>r1<table><tr><td>deep</td></tr></table></td></tr><tr><td><absatz>r2</absatz></td></tr><tr><th colspan="2">both</th></tr></table><schlussteil>end</schlussteil></doc>"""


def test_blocks_and_grids(spark):
    docs = spark.createDataFrame([(1, DOCUMENT), (2, "<doc><absatz>open"), (3, None), (4, "<doc/>")], "id int, xml string")
    got = {r.id: r for r in docs.select("id", xml_blocks.xml_blocks(F.col("xml")).alias("b"), xml_blocks.xml_cells(F.col("xml")).alias("c")).collect()}
    assert [(b.pos, b.kind, b.cls, b.designation, b.text, b.tbl) for b in got[1].b] == [
        (0, "heading", "art", "", "Artikel 1", None), (1, "paragraph", "abs", "(1)", "One & two three behind", None), (2, "paragraph", None, "", "inner", None), (3, "paragraph", None, "", "r2", 0), (4, "closing", None, "", "end", None),
    ]
    assert [(c.tbl, c.inside, c.row, c.col, c.rows, c.cols, c.text) for c in got[1].c] == [(0, None, 0, 0, 2, 1, "left"), (0, None, 0, 1, 1, 1, "r1"), (1, 0, 0, 0, 1, 1, "deep"), (0, None, 1, 1, 1, 1, "r2"), (0, None, 2, 0, 1, 2, "both")]
    assert got[2].b is None and got[2].c is None and got[3].b is None and got[4].b == []
    cells = docs.where("id = 1").select("id", F.explode(xml_blocks.xml_cells(F.col("xml"))).alias("c")).select("id", "c.*")
    assert {(r.tbl, r.row): (r.current, r.proposed) for r in xml_blocks.two_sides(cells, ["id"]).collect()} == {(0, 0): ("left", "r1"), (0, 1): ("left", "r2"), (0, 2): ("both", "both")}
