"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours under the least node each node sees.

    larger: neighbours above the node move; otherwise the node and its neighbours below it do.
    """
    least = materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    joined = pairs.join(least, "u")
    if larger:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Least node of each node's component, from edges (u long, v long).

    Returns (node, root), one row per node that has a link; loops and null ends are ignored.
    Each round is two joins with a table of one row per node, so no component is gathered
    anywhere; rounds are logarithmic in the longest chain. Raises if ``max_rounds`` is not enough.
    """
    current = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = None
    for _ in range(max_rounds):
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(both, True))
        current = materialize(_star(large, False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
