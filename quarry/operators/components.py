"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the root is the least node of its component.

    In every round each node hooks on to its least neighbour that is below it, the trees so made are cut to
    stars by pointer jumping, and the graph shrinks to its roots; rounds and jumps grow with the logarithm
    of the nodes. Each step is written, so that its lineage is one table."""
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct().withColumn("root", F.col("node")))
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
        while True:
            above = tree.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = materialize(tree.join(above, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")))
            tree = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        new = tree.select(F.col("node").alias("root"), F.col("root").alias("new"))
        roots = materialize(roots.join(new, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        one, two = tree.select(F.col("node").alias("a"), F.col("root").alias("c")), tree.select(F.col("node").alias("b"), F.col("root").alias("d"))
        left = materialize(left.join(one, "a").join(two, "b").where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct())
    return roots
