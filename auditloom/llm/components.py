"""Connected components of a graph of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """A stored table of node and label (the smallest node of its component) for the nodes of edges (a, b), with a further column old.

    Each round gives a node the smallest label among its neighbours, then the
    label of that label, so that a chain's length halves. A node's neighbours
    are reduced to one minimum before they are shuffled.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-links")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"), F.col("a").alias("old"))
    labels = stored(labels, f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.select("node", "label").join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        lower = stored(lower, f"{name}-lower")
        of = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        jumped = stored(lower.join(of, "next").select("node", F.least("next", "far").alias("label"), "old"), f"{name}-labels")
        discard(labels, lower)
        if jumped.filter("label <> old").isEmpty():
            discard(both)
            return jumped
        labels = jumped
