"""Connected components by alternating star contractions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. large: every node sends its larger neighbours to its least one; else itself and its smaller
    ones. A written table of edges is dropped. Each node's least neighbour is a partial aggregate; the join that follows works
    on written tables, so that a hub's edges can be split among tasks."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = keep(both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m")))
    joined = both.join(least, F.col("u") == F.col("x"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    out = keep(out.where("u <> v").distinct())
    drop(least, edges)
    return out


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node of an undirected edge (a, b), the least node it reaches, itself included. Loops and
    edges with a null end connect nothing; repeated edges count once. Any orderable node type will do."""
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    pairs = keep(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _state(pairs)) != before and now[0]:
        before = now
        pairs = _star(_star(pairs, True), False)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
