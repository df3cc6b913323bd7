"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.common import drop_table, join_counted, materialize


def _with_least(edges: DataFrame, at: str, other: str, total: int) -> DataFrame:
    """Adds ``m``, the least ``other`` of the edges at each vertex; a hub's edges stay spread over tasks."""
    least = edges.groupBy(at).agg(F.min(other).alias("m"), F.count("*").alias("degree"))
    return join_counted(edges, least, [at], "degree", total).drop("degree")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Joins the larger neighbours of each vertex to its least neighbour, itself included."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = _with_least(both, "a", "b", 2 * total).where("b > a")
    return met.select(F.least("a", "m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Joins the smaller neighbours of each vertex, and itself, to the least of them. Edges come as a < b."""
    met = _with_least(edges, "b", "a", total)
    return met.select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex that each vertex of ``edges`` (a, b) reaches.

    Steps stop when the edges no longer change, which they do after a number of rounds
    that grows with the logarithm of the number of vertices; each round is written to
    the shared folder. Vertices without an edge to another are not in the result.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name="edges")
    before, state = None, _state(now)
    while state != before:
        after = materialize(_small_star(_large_star(now, state[0]), state[0]), name="edges")
        drop_table(now)
        now, before, state = after, state, _state(after)
    return now.select(F.col("b").alias("v"), F.col("a").alias("component")).union(now.select(F.col("a").alias("v"), F.col("a").alias("component"))).distinct()
