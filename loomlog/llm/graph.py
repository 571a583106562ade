"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Label each end of an edge with the smallest node it can reach.

    Each round hooks every node to its smallest neighbour, shortens the chains
    that arise twice, and contracts the edges; rounds grow with the logarithm of
    the longest path.  A node of very many edges only meets map-side combined
    minima and plain equi-joins, which AQE splits.  Edges that repeat, loops and
    edges with a null end are ignored.

    Returns ``node`` and ``component``; nodes without an edge don't appear.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct()
    e = written(e)
    labels = None
    while not e.isEmpty():
        ends = e.union(e.select("b", "a")).toDF("node", "other")
        up = ends.groupBy("node").agg(F.least("node", F.min("other")).alias("p"))
        up = written(up)
        for _ in range(2):
            upper = up.toDF("p", "pp")
            up = up.join(upper, "p").select("node", F.col("pp").alias("p"))
        up = written(up)
        if labels is None:
            labels = up.toDF("node", "component")
        else:
            labels = written(
                labels.join(up.toDF("component", "p"), "component", "left").select(
                    "node", F.coalesce("p", "component").alias("component")
                )
            )
        e = written(
            e.join(up.toDF("a", "pa"), "a")
            .join(up.toDF("b", "pb"), "b")
            .select(F.col("pa").alias("a"), F.col("pb").alias("b"))
            .where("a != b")
            .distinct()
        )
    return labels if labels is not None else e.toDF("node", "component")
