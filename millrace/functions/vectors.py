"""Embedding similarity of a pair: a second opinion on a near miss."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector or unequal lengths."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), _dot(a, b) / norm)
