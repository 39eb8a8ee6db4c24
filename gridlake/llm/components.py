"""Connected components of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) from links (a, b): the label is the smallest node that can be reached.

    Each round gives every node the smallest label among itself and its
    neighbours, then the label of its label.  Labels are combined map-side, so
    a node with very many links is no bottleneck; the lineage is cut by a
    written table each round.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = least.join(jump, "label").select("node", "old", F.least("label", "far").alias("label"))
        after = written(after, "labels")
        labels = after.select("node", "label")
        if after.filter("label < old").isEmpty():
            return labels
