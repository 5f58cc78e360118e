"""Connected components of a link table, by least labels and pointer jumping in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node that it reaches) of all nodes of links(a, b).

    Every round takes the least label of a node's neighbours and then the label of that label, so a
    chain halves a round. Labels are a table in the shared folder after each round; none leave it."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both, held = store.materialise(both, "links")
    labels, path = store.materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("top"))
        jumped = lower.join(up, F.col("root") == F.col("up"), "left").select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root"))
        table, new = store.materialise(jumped, "labels")
        changed = table.where("root <> old").limit(1).count()
        store.drop_path(links.sparkSession, path)
        labels, path = table.select("node", "root"), new
        if not changed:
            store.drop_path(links.sparkSession, held)
            return labels
