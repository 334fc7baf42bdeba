"""Connected components of a graph of any size, in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """node and the least node that it reaches, of edges (a, b); nodes without an edge aren't returned.

    Least labels go along edges and are then looked up in themselves, so a chain of labels
    halves with each round. Each round is a staged table.
    """
    both = stage(edges.select("a", "b").unionAll(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("__n")).agg(F.min("label").alias("__l"))
        lower = labels.join(heard, labels["node"] == heard["__n"]).select("node", F.col("label").alias("old"), F.least("label", "__l").alias("label"))
        up = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        lower = stage(lower.join(up, lower["label"] == up["__n"]).select("node", "old", F.least("label", "__l").alias("label")), "labels")
        labels = lower.select("node", "label")
        if not lower.where("label < old").limit(1).count():
            return labels
