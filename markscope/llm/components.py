"""Connected components of an edge table with DataFrame operations only.

Alternating large-star and small-star steps: every step rewires each node to the smallest
neighbour it sees, so chains shrink by about half and hubs never meet as one group: a node's
neighbours are only reduced with ``min`` (partial aggregation) and joined back on the node, a join
that AQE can split when a hub is hot.  Each round is a written table, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return (both.filter(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("n"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    moved = down.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; component: its smallest node.

    Null ends and loops are ignored.  Nodes that are their own component's smallest are included.
    """
    edges = written(edges.filter("u is not null and v is not null and u <> v")
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = _state(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        edges = written(_small_star(_large_star(edges)), name)
        after = _state(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError(f"no convergence after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
