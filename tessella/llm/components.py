"""Connected components over an edge table, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import discard, stash


def components(edges: DataFrame) -> DataFrame:
    """Each node of ``edges`` (a, b: long) with the smallest node that it is linked to.

    Returns node, label. Every round takes the smallest label among a node and its neighbours, then follows
    labels of labels, so that the distance to the smallest node about halves; labels only fall, and when
    none changes each component agrees. All tables of a round are written ones: a node with very many
    neighbours, or a label that most nodes share, is a hot key of a plain join that adaptive execution
    splits, and minima are combined before they are shuffled. An empty edge table gives no rows.
    """
    both = edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    both = stash(both.select("e.a", "e.b"), "edges")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = stash(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "nearer")
        far = nearer.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        before, labels = labels, stash(nearer.join(far, "label", "left").select("node", "old", F.least("label", "beyond").alias("label")), "labels")
        discard(before, nearer)
        if not labels.where("label <> old").limit(1).count():
            discard(both)
            out = labels.drop("old")
            out.stashed_at = labels.stashed_at
            return out
