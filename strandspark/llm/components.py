"""Connected components by minimum labels with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table


def connected_components(links: DataFrame, folder: str, tag: str, most_rounds: int = 200) -> DataFrame:
    """(``node``, ``component``) for the nodes of ``links`` (``a``, ``b``); the component is its smallest node.

    Each round takes the least label among neighbours and then the label of that label, so
    the rounds follow the logarithm of the longest path. Labels are written to the shared
    folder each round; only a count reaches the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both, folder, f"{tag}-edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), folder, f"{tag}-0")
    for k in range(1, most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = met.join(up, "label", "left").select("node", "old", F.least("label", "top").alias("label"))
        new = cut(new, folder, f"{tag}-{k}")
        changed = new.filter("old <> label").limit(1).count()
        drop_table(links.sparkSession, folder, f"{tag}-{k - 1}")
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
