"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import drop_table, hot_keys, joined_salted, materialize


def components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (a, b: any orderable type) with the least node it can reach: node, component.

    Each round takes the least label among a node's neighbours, then the label
    of that label, and writes the labels to the shared folder, so a lost
    executor costs one round at most. Rounds grow with the logarithm of the
    longest path in practice; the loop ends when no label changes. A node or
    component that a third of all edges touch is dealt over many tasks. Nulls in
    a or b and loops are ignored; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialize(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    written = labels
    hubs = materialize(hot_keys(both, "b"), "hubs")
    while True:
        near = joined_salted(both, labels.select(F.col("node").alias("b"), "label"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = joined_salted(step, jump, "label").select("node", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("old")).alias("moved"))
        step = materialize(step, "labels")
        drop_table(written)
        labels, written = step.select("node", "label"), step
        if not step.where("moved").limit(1).count():
            drop_table(both)
            drop_table(hubs)
            return labels.select("node", F.col("label").alias("component"))
