"""Connected components of a table of links, by smallest label with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common as c


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node of a link can reach. Links to oneself, repeated links and an empty table are fine.

    A node with a large share of all links, or a label with a large share of all nodes, is split among tasks.
    """
    both = c.saved(links.selectExpr(f"{a} as x", f"{b} as y").union(links.selectExpr(f"{b} as x", f"{a} as y")).distinct(), "links")
    degrees = c.saved(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label"), F.count("*").alias("n")), "degrees")
    n_links, n_nodes = degrees.agg(F.sum("n"), F.count("*")).first()
    centres = c.hot_keys(degrees.select(F.col("node").alias("y"), "n"), ["y"], n_links or 0)
    labels, past = degrees.select("node", "label"), None
    while True:
        near = c.skew_join(both, labels.withColumnRenamed("node", "y"), ["y"], None, 0, ["x"], found=centres)
        near = near.groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # a label's own label is at least as small, which halves the way to the smallest
        jump = labels.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("next"))
        size = labels.groupBy("label").agg(F.count("*").alias("n"))
        fresh = c.skew_join(step, jump, ["label"], size, n_nodes, ["node"], "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        fresh, changed = c.saved_and_counted(fresh, "labels", F.col("label") != F.col("old"))
        if past is not None:
            c.forget(past)
        past, labels = fresh, fresh.drop("old")
        if not changed:
            c.forget(both), c.forget(degrees)
            return labels
