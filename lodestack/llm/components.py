"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.shared import drop_kept, keep, sized


def _with_least(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """edges(u, v) with m, the least of u and its neighbours. The least is counted before it is joined back, and both
    sides of the join are plain exchanges, so a node with very many neighbours is split between tasks."""
    least = keep(sized(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), most), "cc-least")
    return edges.join(least, "u"), least


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): every node that an edge(a, b) names, with the least node it reaches.

    Nulls and loops are left out; repeated edges count once. Each round is a few shuffles of the edges; the number of
    rounds grows with the logarithm of the longest path.
    """
    e = keep(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    most = 2 * e.count()  # no step has more rows
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, least = _with_least(both, most)
        large = keep(sized(joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), most), "cc-large")
        drop_kept(least)
        joined, least = _with_least(large, most)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = keep(sized(small, most), "cc-small")
        state = small.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        drop_kept(least, large, e)
        e = small
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
