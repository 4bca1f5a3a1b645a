"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelake.llm.common import HOT_PARTS, HOT_ROWS, checkpointed, spread_join


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """One round. Each node's least neighbour is a grouped minimum, combined before the shuffle, so a node with very many
    links costs one row per task; no neighbour list is gathered, and the links of hot nodes stay where they are."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.filter("b <= a")
    least = around.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    above = max(HOT_ROWS, 2 * n_edges / HOT_PARTS)
    moved = spread_join(around, least, ["a"], above=above) if n_edges > above else around.join(least, "a")
    if large:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the links (a, b): component is the least node reachable.

    Nulls and self links are ignored; repeated links count once; no links give no rows. Only two sums reach the driver.
    """
    current = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    )
    mark, n_edges = None, current.count()
    for _ in range(max_rounds):
        current = checkpointed(_star(_star(current, True, n_edges), False, 2 * n_edges))
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, n_edges = now, now[0]
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
