"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for each node of ``edges``; component is the smallest node reachable.

    Each round is a few shuffles of the edges that are left, written to the shared
    folder; rounds grow with the logarithm of a component's diameter. Edges never
    leave the executors, not even for a broadcast, and no node's neighbours are gathered in a list. Self-loops and
    edges with a null end are dropped.
    """
    a, b = F.col(left), F.col(right)
    stars = materialize(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    state = _state(stars)
    while state[0]:
        # Large star: each node ties its larger neighbours to the smallest of its neighbourhood.
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: each node ties its smaller neighbours, and itself, to the smallest of them.
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        tied = large.join(smallest.hint("merge"), "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = materialize(tied.unionByName(smallest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        state, before = _state(stars), state
        if state == before:
            break
    roots = stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return stars.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).unionByName(roots)
