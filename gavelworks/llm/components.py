"""Connected components of an undirected edge table, by contraction; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import contracted
from .common import Work


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp): comp is the smallest node reachable.

    Self loops, repeated edges and nulls are ignored; an empty edge table gives
    an empty result.  Hubs are harmless: labels are aggregated map-side and the
    label join may be split by adaptive execution.
    """
    e = work.save(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    return contracted(e.select(F.col("a").alias("node")).union(e.select("b")).distinct(), e)
