"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge; ``root`` is the smallest node reachable.

    ``edges`` has the columns ``a, b`` (long, never null). Every round points each root at its
    smallest neighbour, follows the pointers to their ends, and draws the edges anew between
    the roots; a round at least halves the roots that have edges. Sums per node are combined
    before the shuffle, so a node with very many edges costs no task more than the others.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = staged(pairs.distinct(), "edges")
    roots = None
    while not pairs.isEmpty():
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = both.groupBy("a").agg(F.min("b").alias("b"))
        pointers = staged(pointers.select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
        while True:  # pointers lead to ever smaller nodes, so they end
            onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = pointers.join(onward, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            jumped = staged(jumped, "roots")
            pointers = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if roots is None:
            roots = pointers
        else:
            roots = staged(relabel(roots, pointers, "root"), "roots")
        pairs = relabel(relabel(pairs, pointers, "a"), pointers, "b").where("a <> b")
        pairs = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if roots is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def relabel(frame: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``column`` with each node replaced by its root; nodes without a root stay."""
    new = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = frame.join(new, frame[column] == new["_node"], "left")
    return joined.select(*[F.coalesce("_root", c).alias(c) if c == column else c for c in frame.columns])
