"""Connected components of a graph in tables, without collecting nodes or edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import written


def roots(parents: DataFrame) -> DataFrame:
    """node, root from node, parent without cycles, at most one row for each node: pointer jumping, in as many
    rounds as the logarithm of the longest path."""
    now = written(parents.select("node", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        now = written(now.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) from edges a, b: each round every node takes its least neighbour
    as parent, trees are contracted to their roots, and the edges between roots go to the next round."""
    now, labels = written(edges.select("a", "b").filter("a != b"), "edges"), None
    while not now.isEmpty():
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(now.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("parent"))
        tree = roots(least.filter("parent < node"))
        if labels is None:
            labels = written(tree, "labels")
        else:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            old = labels.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            labels = written(old.unionAll(tree.join(labels.select("node"), "node", "left_anti")), "labels")

        def lifted(side: str, rows: DataFrame, tree: DataFrame = tree) -> DataFrame:
            up = tree.select(F.col("node").alias(side), F.col("root").alias("up"))
            return rows.join(up, side, "left").withColumn(side, F.coalesce("up", side)).drop("up")

        now = written(lifted("b", lifted("a", now)).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
