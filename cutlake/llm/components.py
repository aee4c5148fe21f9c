"""Connected components of a link table, by rounds of label passing in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.llm import store


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``: the smallest node it is linked to over any path.

    Each round hooks a node to the smallest label among its neighbours and then
    follows labels once (pointer jumping), so that the number of rounds grows
    with the logarithm of the longest path. A hub's neighbours are reduced by a
    minimum before they meet. Rounds are written to the shared folder.
    """
    pairs = links.where("a <> b").select("a", "b")
    edges = store.keep(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = store.keep(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("_near"))
        # what a node learns is also told to its root, so that whole trees hook at once
        told = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", F.coalesce("_near", "root")).alias("_new"))
        hooks = told.select(F.col("node").alias("_n"), F.col("_new").alias("_v")).union(told.where("_new < root").select("root", "_new"))
        best = hooks.groupBy("_n").agg(F.min("_v").alias("_v"))
        jump = best.select(F.col("_n").alias("_m"), F.col("_v").alias("_w"))
        after = best.join(jump, F.col("_v") == F.col("_m"), "left").select(F.col("_n").alias("node"), F.least("_v", F.coalesce("_w", "_v")).alias("root"))
        after = store.keep(after, "labels")
        moved = after.join(labels, "node").where(after["root"] < labels["root"]).limit(1)
        if moved.isEmpty():
            return after
        labels = after
