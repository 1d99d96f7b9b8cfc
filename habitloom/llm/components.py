"""Connected components of a link table, by rounds of Spark jobs."""

from pyspark.sql import DataFrame, functions as F

from habitloom.session import materialize


def _flatten(parents: DataFrame) -> DataFrame:
    """Follow ``(node, parent)`` to the end; parents are smaller than their nodes, so this stops."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = materialize(parents.join(up, "parent", "left").select(
            "node", F.coalesce("next", "parent").alias("parent"), (F.col("next") < F.col("parent")).alias("moved")), "component-parents")
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node reachable.

    Each round hangs every node under its smallest neighbour (a minimum per
    node, summed up before the shuffle, so a hub costs a row per task), follows
    the chains by pointer jumping, and rewrites the links between the chains'
    ends. What remains shrinks by half or more each round. Every round is
    written to the shared folder; nothing of the graph is brought to the driver.
    """
    links = materialize(links.select("a", "b").where("a <> b").distinct(), "component-links")
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("parent"))
        parents = _flatten(materialize(parents, "component-parents"))
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("root"))
        else:
            up = parents.select(F.col("node").alias("root"), F.col("parent").alias("next"))
            labels = labels.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        labels = materialize(labels, "component-labels")
        end = lambda x: parents.select(F.col("node").alias(x), F.col("parent").alias(f"{x}_end"))
        links = materialize(
            links.join(end("a"), "a").join(end("b"), "b").select(F.col("a_end").alias("a"), F.col("b_end").alias("b")).where("a <> b").distinct(),
            "component-links")
        if links.isEmpty():
            return labels
