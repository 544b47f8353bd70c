"""Connected components by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    if large:
        near = edges.union(edges.select(b.alias("a"), a.alias("b")))
    else:
        near = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(b.alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(b.alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for the nodes of ``edges(a, b)``; the root is the least node of the component.

    Lineage is cut by a written table each round, so lost executors cost one round at most.
    """
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = written(_star(_star(now, True), False), "edges")
        last, seen = seen, mark(now)
        if last == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
