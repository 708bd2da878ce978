"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

``STAGES`` are (name, function) in order; a function takes (spark, docs, sf_dir)
and returns a DataFrame. ``run`` writes each stage's result as Parquet in the
shared folder and reads it again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import langid, linededup, mixing, neardup, packing
from strandline.llm.common import drop_table, materialize


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one learned language; texts that are null, empty or without a letter go, and texts of which no language holds half.

    A null ``lang`` is filled with the predicted one. Repeated rows stay or go
    together; ids may be null or repeat; texts of any length are read whole; no
    documents give none; other columns pass through whatever their names.
    """
    return langid.keep_identified(docs)


def lines_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that came before (equal or one edit away, by doc_id and line; null ids first).

    Null and empty texts stay as they are; identical rows are one place in that
    order and keep the same lines; ``n_chars`` follows; other columns pass through.
    """
    return linededup.dedup_lines(docs)


def near_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: its smallest doc_id.

    Null, empty and blank texts are linked with none and stay. Rows that share an
    id stay or go together; of a group without any id one row stays. Long texts
    count whole; other columns pass through.
    """
    return neardup.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words in the sources' target shares: a row per document and pass, its text the words that the pass takes.

    A null source is a source, the last; null and empty texts have no words and
    are not drawn. Repeated rows are drawn each; no document gives more than
    twice its words; other columns pass through.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their sequence and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one, of the end token alone; texts longer than a
    sequence are cut, others never; repeated rows and null ids are packed each.
    """
    return packing.pack_documents(docs)


STAGES = [("language_id", identified), ("line_dedup", lines_deduped), ("near_dedup", near_deduped), ("mix_sources", mixed), ("best_fit_packing", packed)]

#: Mixing draws by hash and packing tokenizes: SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the whole of ``documents``. A stage's table is deleted once the next stage's stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: DataFrame | None = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
            if before is not None:
                drop_table(before)
            before = docs
    return docs
