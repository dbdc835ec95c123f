"""Exact dedup: a Bloom filter of repeated hashes decides which rows have to shuffle at all.

Two texts are equal when they are identical after lower-casing A-Z; null counts as empty.  Of equal
texts the row with the largest id stays (null ids rank lowest).

First pass: each row's hash names a block of the filter and two bits in it.  Bits that two rows
or more ask for are kept as 4 KB bitmaps, one per block.  Second pass: a row whose two bits are both
kept may have an equal; only such rows shuffle.  All others pass straight through.  The filter has 16
bits a row up to MAX_BITS, so what is broadcast never exceeds MAX_BITS / 8 bytes; beyond that size it
gets fuller and lets more rows through to the shuffle, and the result is the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .common import col, lower_ascii

BITS_A_ROW = 16
BLOCK_BITS = 32768  # bits in one bitmap of the engine's bitmap functions
MAX_BITS = 1 << 29  # 64 MB
HOT_GROUPS = 1000


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(lower_ascii(text).cast("binary"), 256)


def filter_blocks(rows: int) -> int:
    """Blocks of the filter, a power of two."""
    wanted = min(MAX_BITS, max(1, rows) * BITS_A_ROW)
    return 1 << max(0, math.ceil(math.log2(wanted / BLOCK_BITS)))


def _place(sha: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block and two bit numbers, from separate bits of one 64-bit hash."""
    bits = F.xxhash64(sha)
    low = BLOCK_BITS - 1
    return (
        bits.bitwiseAND(F.lit(blocks - 1)),
        F.shiftrightunsigned(bits, 24).bitwiseAND(F.lit(low)),
        F.shiftrightunsigned(bits, 44).bitwiseAND(F.lit(low)),
    )


def repeated_bits(digests: DataFrame, sha: str, blocks: int) -> DataFrame:
    """(__block, __bitmap): the bits that two rows or more ask for."""
    block, one, two = _place(col(sha), blocks)
    asked = digests.select(block.alias("__block"), F.explode(F.array_distinct(F.array(one, two))).alias("__bit"))
    twice = asked.groupBy("__block", "__bit").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    return twice.groupBy("__block").agg(F.bitmap_construct_agg(F.col("__bit")).alias("__bitmap"))


def with_maybe(rows: DataFrame, sha: str, bitmaps: DataFrame, blocks: int) -> DataFrame:
    """Adds __maybe: false where no other row can have the same hash."""
    block, one, two = _place(col(sha), blocks)

    def held(bit: Column) -> Column:
        byte = F.expr("__bitmap").substr((F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        place = bit.bitwiseAND(F.lit(7)).cast("int")
        return F.call_function("shiftright", value, place).bitwiseAND(F.lit(1)) == 1

    joined = rows.withColumns({"__block": block, "__one": one, "__two": two}).join(F.broadcast(bitmaps), "__block", "left")
    maybe = F.coalesce(held(F.col("__one")) & held(F.col("__two")), F.lit(False))
    return joined.withColumn("__maybe", maybe).drop("__block", "__one", "__two", "__bitmap")


class _Groups:
    """Groups of two rows and more: the few hot ones are broadcast, the others are joined."""

    def __init__(self, space: Workspace, maybe: DataFrame, rows: int):
        # At most HOT_GROUPS groups can hold more than this many rows each.
        self.limit = max(2, math.ceil(rows / HOT_GROUPS))
        grouped = maybe.groupBy("text_sha256").agg(
            F.max("doc_id").alias("__keep"), F.count(F.lit(1)).alias("__size")
        )
        self.all = space.materialize(grouped.filter("__size > 1").withColumnRenamed("text_sha256", "__sha"), "groups")

    def join(self, maybe: DataFrame, sha: str) -> DataFrame:
        """Adds __keep and __size, null for a row without an equal; no group over the limit is shuffled."""
        hot = self.all.filter(F.col("__size") > self.limit)
        tagged = maybe.join(F.broadcast(hot), col(sha) == F.col("__sha"), "left")
        cold = tagged.filter(F.col("__size").isNull()).drop("__sha", "__keep", "__size")
        rest = self.all.filter(F.col("__size") <= self.limit)
        joined = cold.join(rest, col(sha) == F.col("__sha"), "left")
        return tagged.filter(F.col("__size").isNotNull()).unionByName(joined).drop("__sha")


class ExactDedup:
    """Dedup of one table of documents.

    Null text is empty; empty texts form a group like any other.  Rows that repeat an id and a text
    count each; all of them are flagged as kept, and `survivors` returns one of them.  An empty table
    gives empty results.  Other columns are carried along by `survivors`; only names that start with two
    underscores are reserved.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        space = Workspace(docs.sparkSession)
        self.digests = space.materialize(
            docs.select(col(id_col).alias("doc_id"), digest(col(text_col)).alias("text_sha256")), "digests"
        )
        rows = self.digests.count()
        self.blocks = filter_blocks(rows)
        self.bitmaps = space.materialize(repeated_bits(self.digests, "text_sha256", self.blocks), "repeated-bits")
        self.flagged = with_maybe(self.digests, "text_sha256", self.bitmaps, self.blocks)
        self.groups = _Groups(space, self.flagged.filter("__maybe"), rows)

    def decisions(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
        straight = self.flagged.filter("NOT __maybe").select("doc_id", "text_sha256", F.col("doc_id").alias("__keep"), F.lit(1).cast("long").alias("__size"))
        grouped = self.groups.join(self.flagged.filter("__maybe").drop("__maybe"), "text_sha256")
        grouped = grouped.withColumns(
            {
                "__keep": F.when(F.col("__size").isNull(), F.col("doc_id")).otherwise(F.col("__keep")),
                "__size": F.coalesce("__size", F.lit(1).cast("long")),
            }
        )
        return straight.unionByName(grouped).select(
            "doc_id",
            F.col("__keep").alias("keep_id"),
            F.col("__size").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("__keep")).alias("kept"),
            "text_sha256",
        )

    def survivors(self) -> DataFrame:
        """The rows that stay, whole; rows that cannot have an equal are not shuffled."""
        own = self.docs.withColumn("__digest", digest(col(self.text_col)))
        flagged = with_maybe(own, "__digest", self.bitmaps, self.blocks)
        straight = flagged.filter("NOT __maybe").drop("__maybe", "__digest")
        grouped = self.groups.join(flagged.filter("__maybe").drop("__maybe"), "__digest")
        single = grouped.filter("__size IS NULL")
        keepers = grouped.filter(F.col("__size").isNotNull() & col(self.id_col).eqNullSafe(F.col("__keep")))
        keepers = keepers.dropDuplicates(["__digest"])
        return straight.unionByName(single.unionByName(keepers).drop("__digest", "__keep", "__size")).select(
            *[col(c) for c in self.docs.columns]
        )
