"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scratch import materialize, passing


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to rows (node, root), root the smallest node that links reach. Nodes
    without an edge have no row. A node of any degree is met only by map-side aggregation and by
    joins whose other side has one row for each key. An edge from a node to itself gives the node;
    edges with a null end are left out; repeated edges are one; no edges give no rows."""
    with passing(edges.sparkSession) as keep:
        return keep(_rooted(edges.where("a is not null and b is not null")))


def _rooted(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parents = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
    left = edges.select("a", "b")
    while True:
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = materialize(parents.join(above, "root").select("node", F.col("higher").alias("root"), (F.col("higher") < F.col("root")).alias("moved")))
        moved = not jumped.where("moved").isEmpty()
        parents = jumped.select("node", "root")
        if left is not None:
            for end in ("a", "b"):
                left = left.join(parents.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
            left = left.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b")
            left = materialize(left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
            if left.isEmpty():
                left = None
            else:
                hooks = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("hook"))
                parents = materialize(parents.join(materialize(hooks), "node", "left").select("node", F.coalesce(F.least("root", "hook"), "root").alias("root")))
        if left is None and not moved:
            return parents
