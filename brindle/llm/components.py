"""Connected components as joins and aggregations, without an unbounded group in any task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, component) for each node that has a smaller one in its component: the smallest reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond",
    2014). A step takes the smallest neighbour by an aggregation, which Spark combines before its shuffle, and
    joins it back, a join that AQE may split where a hub has many edges; neighbour lists are never gathered. The result
    is a kept table, which its reader may forget.
    Loops, repeated and reversed edges count once; edges with a null end are dropped. No edges: no rows.
    """
    pairs = edges.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
    now = keep(pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(now.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        last, now, before = now, keep(small.union(low).distinct(), "edges"), mark
        forget(last)
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    found._kept_at = now._kept_at
    return found


def _mark(edges: DataFrame) -> tuple:
    """Count and two order-free digests: equal marks mean equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first())
