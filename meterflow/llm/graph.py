"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import cut, drop


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hook neighbours onto the least vertex that each vertex sees; edges hold a > b, once each.

    The least neighbour comes from a partial aggregate and returns by a join, which adaptive
    execution splits where one vertex (a component's root) has very many edges.
    """
    if large:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges
    least = seen.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    if large:
        joined = seen.join(least, "a").where(F.col("b") > F.col("a"))
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(v, component): the least vertex reachable from v, for each vertex v of an edge.

    edges: columns a, b of one orderable type, any order, repeats and loops allowed. Each round's
    edges are written to the shared folder, so no lineage grows and lost executors cost one round.
    Rounds go on until the edges no longer change, which large-star and small-star reach in
    O(log^2 n) of them.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    mark = None
    for _ in range(most_rounds):
        before, now = now, cut(_stars(_stars(now, True), False), name)
        drop(before)
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    else:
        raise RuntimeError(f"{name}: no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("v")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(roots.select("v", F.col("v").alias("component")))
