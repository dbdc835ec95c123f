"""Seed names of known entities, supplied by the user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Places per entity: the canonical name takes the first, its aliases follow.
_STRIDE = 1_000_000


def seed_aliases(entities: DataFrame, order_col: str = "entity_order") -> DataFrame:
    """``(position, canonical, alias)`` from ordered ``(canonical, aliases array)`` rows."""
    every = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.select(
        F.col(order_col).cast("bigint").alias("entity"), "canonical", F.posexplode(every).alias("place", "alias")
    ).select((F.col("entity") * _STRIDE + F.col("place")).alias("position"), "canonical", "alias")


def read_seed_file(spark: SparkSession, path: str) -> DataFrame:
    """Seeds from JSON lines ``{"entity_order": n, "canonical": ..., "aliases": [...]}``."""
    schema = "entity_order BIGINT, canonical STRING, aliases ARRAY<STRING>"
    return seed_aliases(spark.read.schema(schema).json(path))
