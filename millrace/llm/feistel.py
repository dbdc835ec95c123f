"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered from 0 in id order.  A keyed Feistel network over the smallest a x b rectangle that
holds the table permutes the numbers; a result outside the table is permuted again until it is inside
(cycle walking), so the whole is a permutation of exactly the table's row numbers.  Position p lies in
shard p mod n at slot p div n: shard sizes differ by one at most, slots have no gaps, and both follow from
a row number alone, as does the row from (shard, slot).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .common import col

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Feistel:
    """A permutation of range(rows) fixed by its key."""

    rows: int
    key: int = 0

    @property
    def sides(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(0, self.rows - 1)) + 1)
        return a, max(1, -(-self.rows // a))

    def _round(self, i: int, half: np.ndarray, size: int) -> np.ndarray:
        salt = _mix(np.array([(self.key * (ROUNDS + 1) + i + 1) & (2**64 - 1)], dtype=np.uint64))
        return _mix(half + salt) % np.uint64(size)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = self.sides
        left, right = x // np.uint64(b), x % np.uint64(b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                step = self._round(i, left, b)
                right = (right + (np.uint64(b) - step if back else step)) % np.uint64(b)
            else:
                step = self._round(i, right, a)
                left = (left + (np.uint64(a) - step if back else step)) % np.uint64(a)
        return left * np.uint64(b) + right

    def permute(self, numbers: np.ndarray, back: bool = False) -> np.ndarray:
        """Positions of row numbers; with back, row numbers of positions."""
        out = self._once(numbers.astype(np.uint64), back)
        while (outside := out >= np.uint64(self.rows)).any():
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def row_at(self, shard: int, slot: int, shards: int) -> int:
        """The row number found in a shard's slot."""
        return int(self.permute(np.array([slot * shards + shard]), back=True)[0])


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds `row`, 0 to n - 1 in the given order, and returns n with it.

    Rows equal in all the order's columns follow in scan order; a key shared by many rows is cut like
    any other range.  Only the row counts of partitions meet in one place.
    """
    spark = rows.sparkSession
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [col(c).asc_nulls_first() for c in order] + [F.col("__tie").asc()]
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = Workspace(spark).materialize(
        dealt.withColumns({"__part": F.spark_partition_id(), "__inside": inside}), "numbered"
    )
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in sorted(counts):  # one number per partition
        before.append((part, total))
        total += counts[part]
    starts = spark.createDataFrame(before, "__part int, __before long")
    numbered = placed.join(F.broadcast(starts), "__part").withColumn("row", F.col("__before") + F.col("__inside"))
    return numbered.drop("__part", "__inside", "__before"), total


def shuffle_shards(docs: DataFrame, shards: int, key: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row, position, shard, slot for every row.

    Size is the text's UTF-8 bytes plus 16.  Null text counts as empty, null ids come first, repeated rows
    get places of their own, and an empty table gives no rows.  Other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(
        col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    numbered, rows = number_rows(narrow, ["doc_id", "text_crc32", "size"])
    shuffle = Feistel(rows, key)

    @F.pandas_udf("long")
    def position(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in numbers:
            yield pd.Series(shuffle.permute(batch.to_numpy()))

    placed = numbered.withColumn("position", position("row"))
    return placed.withColumns(
        {"shard": (F.col("position") % shards).cast("int"), "slot": F.floor(F.col("position") / shards).cast("long")}
    )
