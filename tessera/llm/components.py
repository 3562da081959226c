"""Connected components of a large graph by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
    return tuple(r)


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge with the least neighbour of its first node. Both sides are plain files,
    so the adaptive planner can split the rows of a hub."""
    return edges.join(least, edges["a"] == least["node"]).select("a", "b", "low")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge list's two integer columns; root is the
    least node of its component.

    Large-star then small-star steps until nothing changes; each step is a shuffle of the
    edges, their number never grows, and the rounds are about the logarithm of the
    longest chain. Loops and repeated edges are harmless; nodes without an edge and
    edges with a null end are left out.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull()).where("a <> b")
    e = written(e.distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = written(both, "both")
        least = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("low")), "least")
        large = _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(large.distinct(), "large")
        low = written(large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")), "least")
        pairs = _with_least(large, low)
        small = pairs.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            large.groupBy("a").agg(F.min("b").alias("b")))
        nxt = written(small.where("a <> b").distinct(), "edges")
        after = _state(nxt)
        discard(both, least, large, low, nxt if after == state else e)
        if after == state:
            break
        e, state = nxt, after
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
