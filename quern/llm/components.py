"""Connected components of a link table, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import discard, stash


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of every node in ``links`` (a, b: bigint).

    Every round each node points to the smallest of itself and its neighbours, pointers are
    followed twice, and links are drawn anew between what they point to, without repeats. A
    round more than halves a component, so there are about log(n) of them; all tables are
    written to the shared folder, and none is collected.
    """
    edges = stash(links.select("a", "b").filter("a <> b").distinct(), "cc-links")
    labels: DataFrame | None = None
    # Tables of a round go when those of the next are written.
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")), "cc-near")
        # Every value of ``to`` is a node of this round, and following leads to smaller ones.
        jump, last_edges, last_labels = near, edges, labels
        for _ in range(2):
            ahead = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jump = jump.join(ahead, "to").select("node", F.col("next").alias("to"))
        jump = stash(jump, "cc-jump")
        if labels is None:
            labels = jump.select("node", F.col("to").alias("label"))
        else:
            step = jump.select(F.col("node").alias("label"), "to")
            labels = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = stash(labels, "cc-labels")
        ends = jump.select(F.col("node").alias("a"), F.col("to").alias("a_to"))
        edges = edges.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("a_to").alias("b_to")), "b")
        edges = stash(edges.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).filter("a <> b").distinct(), "cc-links")
        discard(near, jump, last_edges, *([last_labels] if last_labels is not None else []))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
