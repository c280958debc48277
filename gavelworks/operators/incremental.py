"""Connected components of a growing graph: labels are stored, and new edges contract only the components they touch.

The labels (node, comp), comp being the smallest node reachable, lie in a ``KeyedTable``.  New edges are taken from
nodes to the components they stand for; what is left is a graph between touched components, which is contracted like
any other.  Nodes of components that got a smaller label are relabelled, in one commit with the new nodes: after a
crash the old labels hold and the same edges can be appended again.  Buckets without such nodes aren't rewritten.

Finding the members of a relabelled component reads the labels once (two columns, no shuffle of the labels for a short
list of moves); a component is rewritten only when a smaller node joins it.

Defined cases: null ends, self loops and repeated edges are ignored; nodes without edges are their own component; an
edge's unknown ends are new nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import BUCKETS, KeyedTable
from . import graph


class Components:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.table = KeyedTable(spark, path, "node", buckets=buckets)

    def labels(self) -> DataFrame | None:
        """(node, comp), None before the first append."""
        return self.table.read()

    def append(self, edges: DataFrame, nodes: DataFrame | None = None, epoch: int | None = None) -> list[int]:
        """Add edges (a, b) and single nodes (node); returns the buckets that were rewritten."""
        e = edges.select("a", "b").where("a is not null and b is not null")
        ends = e.select(F.explode(F.array("a", "b")).alias("node"))
        if nodes is not None:
            ends = ends.unionByName(nodes.select("node").where("node is not null"))
        ends = ends.distinct()
        old = self.table.read()
        if old is None:
            known = ends.withColumn("comp", F.lit(None).cast(ends.schema["node"].dataType))
        else:
            hit = [r.b for r in ends.select(self.table.bucket("node").alias("b")).distinct().collect()]  # no more than there are buckets
            known = ends.join(self.table.read(hit), "node", "left")
        # the component of every end; a new node is one of its own so far
        known = graph.cut(known.select("node", F.coalesce("comp", "node").alias("comp"), F.col("comp").isNull().alias("new")))
        of = known.select("node", "comp")
        between = e.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
        to = graph.contracted(of.select(F.col("comp").alias("node")).distinct(), between).toDF("comp", "to")
        fresh = known.where("new").join(to, "comp").select("node", F.col("to").alias("comp"))
        moved = fresh
        if old is not None:
            moves = to.where("comp <> to")
            moved = fresh.unionByName(old.join(moves, "comp").select("node", F.col("to").alias("comp")))
        return self.table.upsert(moved, epoch)
