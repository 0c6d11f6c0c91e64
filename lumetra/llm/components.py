"""Connected components by alternating large and small stars, all in DataFrames.

Defined cases: edges may be repeated, in either direction, or lead from a node
to itself; edges with a null end are left out; no edges give no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed


#: Edges (some 3 MB) up to which one task finds the components.
FEW = 200_000
#: Edges from which a round writes its minima before it joins them.
LARGE = 2_000_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b.

    A root meets all its edges by its own key. Where minima are written first
    (``large``), both sides of that join are plain shuffles, and adaptive
    execution splits the root's side over as many tasks as it needs.
    """
    apart = checkpointed if large else lambda df: df
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = apart(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
    hung = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    hung = apart(hung)
    root = apart(hung.groupBy("a").agg(F.min("b").alias("m")))
    joined = hung.join(root, "a")
    small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(root.select("a", F.col("m").alias("b")))
    return small.filter("a > b").distinct()


def united(edges: pa.Table) -> pa.Table:
    """Roots of the nodes of a few edges: the least node of each tree stands above the others."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = x = above.get(above[x], above[x])
        return x

    for a, b in zip(edges["a"].to_pylist(), edges["b"].to_pylist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    return pa.Table.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not its component's least; ``edges`` has columns a and b, in any order.

    Each round is written to the checkpoint folder; rounds grow with the
    logarithm of a component's diameter, not with its size. ``FEW`` edges or
    less, at the start or left by a round, are settled in one task.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        now = (now[0], int(now[1]))
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        if now[0] <= FEW:
            return edges.groupBy(F.lit(0).alias("all")).applyInArrow(united, "node long, root long")
        edges = checkpointed(_stars(edges, now[0] > LARGE))
