"""Relations between the output tables as edges, and hops over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EDGE = ("src", "relation", "dst")


def builds_edges(products: DataFrame) -> DataFrame:
    """Startup BUILDS product; the product is named by its source address."""
    return products.select(
        F.col("`content.startupName`").alias("src"), F.lit("BUILDS").alias("relation"), F.col("`source.url`").alias("dst")
    )


def employs_edges(jobs: DataFrame) -> DataFrame:
    """Startup EMPLOYS_VIA job posting."""
    return jobs.select(
        F.col("`content.company`").alias("src"), F.lit("EMPLOYS_VIA").alias("relation"), F.col("`source.url`").alias("dst")
    )


def follow(edges: DataFrame, starts: DataFrame, relations: list[str]) -> DataFrame:
    """Distinct ``(start, node)`` pairs reached by a chain of relations.

    Duplicates go after every hop, so paths that meet do not multiply.
    """
    reached = starts.select(F.col("node").alias("start"), "node")
    for relation in relations:
        step = edges.filter(F.col("relation") == relation).select(F.col("src").alias("node"), F.col("dst").alias("next"))
        reached = reached.join(step, "node").select("start", F.col("next").alias("node")).distinct()
    return reached


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("dst").alias("src"), F.concat("relation", F.lit("_OF")).alias("relation"), F.col("src").alias("dst")
    )
