"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


#: Edges of one node that one task gets.
HOT_EDGES = 2000


def _with_least(edges: DataFrame, count: int) -> DataFrame:
    """``edges`` with ``m``, the least ``b`` of each ``a``.

    A node with very many edges gets its least neighbour by broadcast, so that its edges stay where they
    are. Only nodes with more than a five-thousandth of all edges can be such, so they are 5000 at most."""
    low = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    hot = F.col("n") > max(HOT_EDGES, count // 5000)
    few = F.broadcast(low.where(hot).select("a", "m"))
    rest = edges.join(few.select("a"), "a", "left_anti").join(low.where(~hot).select("a", "m"), "a")
    return edges.join(few, "a").unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: (a, b) longs, either way. Returns (node, component) for every node of an edge; the
    component is the smallest node. Stars of any size are joined through minima, never listed.
    Each round is a written table; rounds grow with the logarithm of the longest path."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-stars")
        met = _with_least(large, state[0])
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.where("b = m").select("a", F.col("m").alias("b")))
        new = written(small.where("a <> b").distinct(), "edges")
        was, state = state, _state(new)
        remove(e)
        remove(large)
        e = new
        if state == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
