"""Connected components of an edge table, by contraction.

Each round hooks every node to its smallest neighbour, follows the hooks to their roots and replaces the nodes of the
edges by their roots. At least every second root that still has an edge disappears, so rounds grow with the logarithm of
the nodes, whatever the shape (stars, long chains). Each round's tables are written to the shared folder: lineage stays
short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.sources.session import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges(a, b)``; the root is the smallest node of its component.

    Ids are longs. Direction, repeats and loops do not matter; edges with a null end are ignored; no edges, no rows.
    """
    left = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not left.isEmpty():
        hooks = _roots(left)
        if roots is None:
            roots = hooks
        else:
            moved = roots.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            roots = written(moved.select("node", F.coalesce("next", "root").alias("root")))
        a = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = left.join(a, "a").join(b, "b").filter("ra <> rb")
        left = written(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _roots(edges: DataFrame) -> DataFrame:
    """Every node with the root that its chain of smallest neighbours ends in. Hooks only go down, so they end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                                          F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
    hooks = written(ends.groupBy("e.node").agg(F.min("e.other").alias("other"))
                    .select("node", F.least("node", "other").alias("root")))
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = written(hooks.join(up, "root").select("node", F.col("root").alias("was"), F.col("next").alias("root")))
        moved = not jumped.filter("was <> root").isEmpty()
        hooks = jumped.select("node", "root")
        if not moved:
            return hooks
