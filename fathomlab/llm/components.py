"""Connected components of links between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import BROADCAST_ROWS, settle

#: Partitions of a result that was counted and is small.
FEW_PARTS = 8


def components(edges: DataFrame) -> DataFrame:
    """node, label: connected components, labelled by their least node. Labels spread along edges and
    jump to their label's label, so the rounds needed grow with the logarithm of a path's length. Few
    labels (counted once) are broadcast and kept in few partitions."""
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    few = labels.count() <= BROADCAST_ROWS
    near_by, kept = (F.broadcast, lambda df: settle(df.coalesce(FEW_PARTS))) if few else (lambda df: df, settle)
    if few:
        both, labels = settle(both.coalesce(FEW_PARTS)), kept(labels)
    while True:
        near = both.join(near_by(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = kept(
            labels.join(near_by(jump), "label", "left")
            .join(near_by(near), "node", "left")
            .select("node", F.least("label", F.coalesce("far", "label"), F.coalesce("near", "label")).alias("new"), "label")
        )
        changed = not new.filter("new <> label").isEmpty()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
