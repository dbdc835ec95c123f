"""Joins that survive hot keys, and connected components by alternating stars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace

HOT_KEYS = 1000
BROADCAST_ROWS = 1_000_000  # narrow rows: a few tens of megabytes


def small(df: DataFrame) -> DataFrame:
    """Marks a narrow table for broadcast where it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_groups(left: DataFrame, groups: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Joins rows with one row per key that holds the key's row count in __size.

    No more than HOT_KEYS keys can hold over total / HOT_KEYS rows each; their groups are broadcast, so that
    their rows never meet in one task.  All other keys are shuffled.
    """
    limit = max(1, math.ceil(total / HOT_KEYS))
    hot = groups.filter(F.col("__size") > limit).withColumn("__hot", F.lit(True))
    cold = groups.filter(F.col("__size") <= limit)
    tagged = left.join(F.broadcast(hot), key, "left")
    new = [c for c in groups.columns if c != key]
    rest = tagged.filter("__hot IS NULL").drop("__hot", *new).join(cold, key, how)
    return tagged.filter("__hot").drop("__hot").unionByName(rest)


def _star(edges: DataFrame, space: Workspace, large: bool) -> DataFrame:
    """One star step over (u, v): neighbours of u on one side are tied to the smallest of all."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.least(F.min("v"), F.col("u")) if large else F.min("v")
    mins = edges.groupBy("u").agg(least.alias("__m"), F.count(F.lit(1)).alias("__size"))
    mins = space.materialize(mins, "star-mins")
    total = mins.agg(F.sum("__size").alias("n")).first()["n"] or 0
    joined = join_groups(edges, mins, "u", total)
    if large:
        tied = joined.filter("v > u").select(F.col("v").alias("u"), F.col("__m").alias("v"))
    else:
        tied = joined.select(F.col("v").alias("u"), F.col("__m").alias("v")).unionByName(mins.select("u", F.col("__m").alias("v")))
    return tied.filter("u <> v").distinct()


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Edges are (a, b) with numbers.  Alternating large-star and small-star steps (Kiveris et al., SoCC 2014) end
    in a few rounds also on long chains; every step is written down, so a lost executor repeats one step.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    now = space.materialize(
        edges.filter("a <> b").select(larger.alias("u"), smaller.alias("v")).distinct(), "edges"
    )
    seal = None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (found["n"], found["x"]) == seal or not found["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seal = (found["n"], found["x"])
        now = space.materialize(_star(now, space, large=True), "large-star")
        now = space.materialize(_star(now, space, large=False), "small-star")
