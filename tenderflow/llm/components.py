"""Connected components of a link table by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.llm.storage import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the smallest node that can be reached.

    Each round maps every root to the smallest root next to it, follows that map once more, and contracts the
    links; the number of roots at least halves, so rounds grow with the logarithm of the longest path. Nothing
    is collected: only whether links are left is asked.
    """
    edges = links.select("a", "b").where("a <> b")
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("root"), F.least("a", "near").alias("to"))
        step = written(step, "roots")
        jump = step.select(F.col("root").alias("to"), F.col("to").alias("next"))
        step = written(step.join(jump, "to", "left").select("root", F.coalesce("next", "to").alias("to")), "roots")
        if labels is None:
            labels = step.select(F.col("root").alias("node"), F.col("to").alias("label"))
        else:
            move = step.select(F.col("root").alias("label"), F.col("to").alias("next"))
            labels = labels.join(move, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
            labels = written(labels, "labels")
        left = step.select(F.col("root").alias("a"), F.col("to").alias("a_to"))
        right = step.select(F.col("root").alias("b"), F.col("to").alias("b_to"))
        edges = edges.join(left, "a").join(right, "b").where("a_to <> b_to")
        edges = written(edges.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels
