"""Amending instructions made of the test tables' lines, read and applied; brute-forced in tests, as no SQL walks a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import novelle
from strandline.plans.base import registry, table

QUERIES, SQL, query = registry()


def laws(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every line of a document as a unit (doc_id, address, text), and as an instruction (doc_id, seq, line) of a kind and place by a hash; lines 5 and 6 swap two numbers."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "said"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "n")), 1, 4), 16, 10).cast("int")
    lines = lines.select("doc_id", F.col("n").cast("long").alias("n"), F.regexp_replace("said", "[„“]", "").alias("said"), h.alias("h"))
    number = lambda c: F.concat(F.lit("§ "), c.cast("string"))
    place = F.when(F.col("h") % 11 == 0, F.lit("Abs. 1")).otherwise(number(F.col("h") % 12 + 1))
    quoted = F.concat(F.lit("„"), F.col("said"), F.lit("“"))
    word = F.regexp_extract("said", r"(\S+)", 1)
    kind = F.floor(F.col("h") / 16) % 5
    made = F.when(F.col("n") == 5, "§ 1 erhält die Bezeichnung „§ 2“.").when(F.col("n") == 6, "§ 2 erhält die Bezeichnung „§ 1“.").when(kind == 0, F.concat(place, F.lit(" entfällt."))).when(kind == 1, F.concat(place, F.lit(" lautet: "), quoted))
    made = made.when(kind == 2, F.concat(F.lit("Folgender "), place, F.lit(" wird eingefügt: "), quoted)).when(kind == 3, F.concat(F.lit("In "), number(F.col("n")), F.lit(" wird „"), word, F.lit("“ durch „x“ ersetzt."))).otherwise(F.col("said"))
    units = lines.select("doc_id", F.concat(F.lit("§"), (F.col("n") + 1).cast("string")).alias("address"), F.col("said").alias("text"))
    return units, lines.select("doc_id", F.col("n").alias("seq"), made.alias("line"))


def _applied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    units, lines = laws(spark, sf_dir)
    return novelle.applied(units, novelle.parsed(lines, ["doc_id"], "seq", "line"), ["doc_id"])


@query()
def amended_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of every document after its instructions."""
    return _applied(spark, sf_dir)[0].select("doc_id", "address", F.md5("text").alias("text_md5"))


@query()
def instruction_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an instruction was refused; null where it was done."""
    return _applied(spark, sf_dir)[1]
