"""First-seen and content-change tracking by natural key.

Everything is an aggregate over (key, content hash), combined before the shuffle, so a
key that holds a third of all rows stays cheap; no group is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def content_hash(*columns: Column) -> Column:
    """SHA-256 over the columns, with nulls and boundaries told apart."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def first_seen(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """The earliest row per key (ties broken by the row itself, so retries agree)."""
    others = [c for c in df.columns if c not in keys]
    rest = F.struct(*[F.col(c) for c in others])
    ranked = F.struct(F.col(order_col).alias("_order"), F.xxhash64(*df.columns).alias("_tie"))
    return df.groupBy(*keys).agg(F.min_by(rest, ranked).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def unseen(batch: DataFrame, seen: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """First rows of keys that the store of seen keys does not hold yet."""
    return first_seen(batch, keys, order_col).join(seen.select(*keys), keys, "left_anti")


def track_changes(df: DataFrame, key: str, hash_col: str, order_col: str) -> DataFrame:
    """``(key, first_seen, updated_at, content_hash, n_versions)`` per key.

    ``updated_at`` is when the current content came up last; it equals ``first_seen``
    while the content never changed.  Returning to older content counts as a change.
    """
    per_hash = df.groupBy(F.col(key).alias("key"), F.col(hash_col).alias("hash")).agg(
        F.min(order_col).alias("lo"), F.max(order_col).alias("hi")
    )
    current = per_hash.groupBy("key").agg(
        F.min("lo").alias("first_seen"),
        F.max_by("hash", "hi").alias("content_hash"),
        F.max("hi").alias("last"),
        F.count("*").alias("n_versions"),
    )
    # The last sight of any other content starts the current stretch.
    others = (
        per_hash.join(current.select("key", "content_hash"), "key")
        .filter(F.col("hash") != F.col("content_hash"))
        .groupBy("key")
        .agg(F.max("hi").alias("other_until"))
    )
    current = current.join(others, "key", "left")
    # Only keys that changed are looked up again in the rows.
    changed = current.filter(F.col("other_until").isNotNull()).select("key", "content_hash", "other_until")
    starts = (
        df.select(F.col(key).alias("key"), F.col(hash_col).alias("hash"), F.col(order_col).alias("at"))
        .join(changed, "key")
        .filter((F.col("hash") == F.col("content_hash")) & (F.col("at") > F.col("other_until")))
        .groupBy("key")
        .agg(F.min("at").alias("updated"))
    )
    return current.join(starts, "key", "left").select(
        F.col("key").alias(key), "first_seen", F.coalesce("updated", "first_seen").alias("updated_at"), "content_hash",
        "n_versions",
    )
