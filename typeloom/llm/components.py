"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import discard, stash


def connected(edges: DataFrame) -> DataFrame:
    """`node` and `component` (the smallest node reachable) of every node in `edges` (a long, b long).

    Each round a node takes the smallest label among its own and its neighbours' (a grouped
    minimum, combined before the shuffle), then the label of its label. The labels of a round
    are written out, so rounds neither recompute nor lengthen the plan, and those of the round
    before are deleted. Rounds grow with the logarithm of a component's diameter. A label that
    many nodes share is a skewed side of a plain equi-join, which Spark splits.

    Edges with a null end and loops are left out; repeated edges count once; no edges give no rows.
    """
    proper = edges.where("a <> b").select("a", "b")
    both = stash(proper.union(proper.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-edges")
    held = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "components-labels")
    while True:
        labels = held.select("node", "label")
        near = both.join(labels, F.col("b") == F.col("node")).select("a", F.col("label").alias("other"))
        low = near.groupBy("a").agg(F.min("other").alias("other"))
        hooked = labels.join(low, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        nxt = stash(hooked.join(jump, F.col("label") == F.col("via"), "left").select("node", "old", F.least("label", "further").alias("label")), "components-labels")
        discard(held)
        held = nxt
        if not nxt.where("label <> old").limit(1).count():
            discard(both)
            out = nxt.select("node", F.col("label").alias("component"))
            out.stash_path = nxt.stash_path
            return out
