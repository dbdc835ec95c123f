"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: its target mass over its present mass (UTF-8 bytes and one a document).
A document's number of copies is the inverse Poisson distribution with that mean at a point
hashed from the seed and its id, so no coordination is needed, a lost task repeats the same draw, and
the expected mass of each source is its target.  Copies are then put in the order of a hash of (seed, id, copy).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import col

# Tables of rates up to this many sources are broadcast; larger ones are joined with salted sources.
BROADCAST_SOURCES = 10_000
SALTS = 64


def poisson_table(rate: float) -> tuple[int, np.ndarray]:
    """First count with mass and the distribution function from there on, to the last bit of a double."""
    if rate <= 0:
        return 0, np.array([1.0])
    width = 12 * math.sqrt(rate) + 40
    low = max(0, math.floor(rate - width))
    counts = np.arange(low, math.ceil(rate + width) + 1)
    logs = counts * math.log(rate) - rate - np.array([math.lgamma(k + 1) for k in counts])
    return low, np.cumsum(np.exp(logs))


@F.pandas_udf(LongType())
def poisson_inverse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The smallest count whose distribution function at the rate exceeds the point in [0, 1)."""
    tables: dict[float, tuple[int, np.ndarray]] = {}
    for rates, points in batches:
        out = np.zeros(len(rates), dtype=np.int64)
        codes, distinct = pd.factorize(rates)
        for code, rate in enumerate(distinct):
            if rate not in tables:
                if len(tables) > 1000:
                    tables.clear()
                tables[rate] = poisson_table(float(rate))
            low, table = tables[rate]
            at = codes == code
            out[at] = low + np.searchsorted(table, points.to_numpy()[at], side="right")
        yield pd.Series(out)


def point(seed: int, *keys: Column) -> Column:
    """A point in [0, 1) of 52 bits from an MD5 of the seed and the keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    total: float = 1.0,
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """__source, __rate: the mean number of copies of each source's documents.

    Weights are relative targets by source (a source that is not named gets none); without weights the
    target is the present mass to the power of the temperature.  Total scales the mass of the result.
    """
    mass = (F.octet_length(F.coalesce(col(text_col), F.lit(""))) + 1).cast("double")
    stats = docs.groupBy(col(source_col).alias("__source")).agg(F.sum(mass).alias("__mass"))
    if weights is None:
        weighted = stats.withColumn("__weight", F.pow("__mass", F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "__name string, __weight double")
        weighted = stats.join(given, F.col("__source").eqNullSafe(F.col("__name")), "left").drop("__name")
        weighted = weighted.fillna(0.0, ["__weight"])
    sums = weighted.agg(F.sum("__mass").alias("mass"), F.sum("__weight").alias("weight")).first()
    scale = total * sums["mass"] / sums["weight"] if sums["weight"] else 0.0
    return weighted.select("__source", (F.lit(scale) * F.col("__weight") / F.col("__mass")).alias("__rate"))


def poisson_mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    total: float = 1.0,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """All copies of all documents in shuffled order: the input's columns and mix_copy, mix_copies, mix_order.

    Null sources are a source of their own, null texts weigh one byte, rows that repeat an id are drawn
    alike, an empty table gives no rows.  The three new columns replace columns of those names; names that
    start with two underscores are reserved.
    """
    rates = source_rates(docs, weights, temperature, total, source_col, text_col)
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rated = docs.join(F.broadcast(rates), col(source_col).eqNullSafe(F.col("__source")))
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(col(id_col)), F.lit(SALTS)).cast("int")
        rated = docs.join(salted, col(source_col).eqNullSafe(F.col("__source")) & (salt == F.col("__salt"))).drop("__salt")
    drawn = rated.withColumn("mix_copies", poisson_inverse(F.col("__rate"), point(seed, col(id_col))))
    copies = drawn.filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies") - 1)))
    order = F.xxhash64(F.lit(seed), F.lit("order"), col(id_col), F.col("mix_copy"))
    shuffled = copies.withColumn("mix_order", order).drop("__source", "__rate")
    keys = [F.col("mix_order"), col(id_col), F.col("mix_copy")]
    return shuffled.repartitionByRange(*keys).sortWithinPartitions(*keys)
