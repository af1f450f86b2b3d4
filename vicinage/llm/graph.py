"""Connected components of a set of links, by least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable over ``links`` (a, b), for every node that has a link.

    Each round hands every node the least label next to it and then the label of
    its label, which halves the way to the least node.  Rounds are written
    tables; hubs are reached by joins that can be split, never gathered.
    """
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v").distinct(), "links")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        stepped = materialize(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next")), "labels")
        jump = stepped.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = materialize(stepped.join(jump, "next").select("node", "label", F.least("next", "far").alias("next")), "labels")
        changed = moved.filter(F.col("next") != F.col("label")).limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
