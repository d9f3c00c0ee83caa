"""Connected components of a table of links, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import _shared


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has a link; label is the least node of its component.

    Each round takes the least label of a node's neighbours (partial aggregates, so nodes with many links gather in no
    task) and then the label of that label, so long chains halve. Every round is written, and lost executors cost no
    more than the round. Rounds go on until no label changes.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    both = _shared.materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    now = _shared.materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(now.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        least = now.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("next"))
        nxt = _shared.materialize(least.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        if nxt.where("was != label").isEmpty():
            return nxt.select("node", "label")
        now = nxt.select("node", "label")


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after more links (a, b): only links between components count, and components of those."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    across = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a != b")
    across = _shared.materialize(across.distinct(), "across")
    if across.isEmpty():
        return labels
    merged = components(across).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    # nodes without a label so far are their own component
    ends = across.select(F.col("a").alias("node")).unionByName(across.select(F.col("b").alias("node"))).distinct()
    every = labels.unionByName(ends.join(labels.select("label").distinct().withColumnRenamed("label", "node"), "node", "left_anti").select("node", F.col("node").alias("label")))
    return _shared.materialize(every.join(merged, "label", "left").select("node", F.coalesce("whole", "label").alias("label")), "labels")
