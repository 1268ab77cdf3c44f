"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all ends of the links (a, b).

    Each round takes the smallest label among a node's neighbours and then that label's own label; long
    chains halve, so the rounds grow with the logarithm of a chain's length. Every round is written to the
    shared folder; only a count comes back to the driver.
    """
    ends = materialize(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).filter("x <> y").distinct(), "links")
    labels = materialize(ends.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), "labels")
    while True:
        near = ends.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy("x").agg(F.min("component").alias("m"))
        low = labels.join(near, labels["node"] == near["x"]).select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        up = low.select(F.col("node").alias("component"), F.col("component").alias("top"))
        moved = materialize(low.join(up, "component", "left").select("node", "was", F.coalesce(F.least("component", "top"), "component").alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.filter("was <> component").limit(1).count() == 0:
            return labels
