"""Connected components of an edge table, distributed: minimum hooking with contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, label)``: the smallest node reachable, for every node on an edge.

    Each round hooks every vertex to its smallest neighbour, follows one pointer, relabels the edges and drops
    those that became loops; every two rounds at least halve the vertices that still have edges. Counts of edges
    are all that reaches the driver. Joins read materialised tables, so a heavy label can be split at run time.
    Null ends and loops are ignored; an empty table gives an empty one.
    """
    e = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while e.limit(1).count():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("n"), F.least("u", "v").alias("p")))
        up = hook.select(F.col("n").alias("p"), F.col("p").alias("q"))
        hook = cut(hook.join(up, "p", "left").select("n", F.coalesce("q", "p").alias("p")))
        if labels is None:
            labels = hook.select(F.col("n").alias("node"), F.col("p").alias("label"))
        else:
            new = hook.select(F.col("n").alias("label"), F.col("p").alias("q"))
            labels = cut(labels.join(new, "label", "left").select("node", F.coalesce("q", "label").alias("label")))
        left, right = hook.select(F.col("n").alias("u"), F.col("p").alias("a")), hook.select(F.col("n").alias("v"), F.col("p").alias("b"))
        moved = e.join(left, "u").join(right, "v").where("a <> b")
        e = cut(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels
