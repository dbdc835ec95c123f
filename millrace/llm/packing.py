"""Best-fit packing of documents into fixed-size sequences under conflicts.

A bin may hold at most one piece of a source and at most one piece of a duplicate cluster.  Documents longer
than a bin are cut into full pieces and a rest.  Pieces are dealt at random to packing groups of about
GROUP_PIECES pieces, whatever their source or cluster, so no key can make a group large; two pieces
of different groups never meet in a bin, so conflicts need no view across groups.

Within a group pieces come by falling length.  Bins are kept in order of what is left in them, and carry
bitmaps of their sources and clusters; from the smallest rest that holds the piece, successors are tried
until a compatible bin is found, which is then the tightest one.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .common import col, words

GROUP_PIECES = 4096


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the given order.  Codes below zero conflict with nothing."""
    bins: list[int] = []
    offsets: list[int] = []
    by_rest: list[tuple[int, int]] = []  # (what is left, bin), ascending
    held: list[tuple[int, int]] = []  # bitmaps of sources and clusters, by bin
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(by_rest, (length, -1))
        while at < len(by_rest) and (held[by_rest[at][1]][0] & s or held[by_rest[at][1]][1] & c):
            at += 1
        if at < len(by_rest):
            rest, chosen = by_rest.pop(at)
        else:
            rest, chosen = capacity, len(held)
            held.append((0, 0))
        held[chosen] = (held[chosen][0] | s, held[chosen][1] | c)
        if rest > length:
            insort(by_rest, (rest - length, chosen))
        bins.append(chosen)
        offsets.append(capacity - rest)
    return bins, offsets


def _pack_group(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "item", "piece"], ascending=[False, True, True], kind="stable")
        sources = pd.factorize(group["__source"])[0].tolist()
        clusters = pd.factorize(group["__cluster"])[0].tolist()
        group["bin"], group["bin_offset"] = best_fit(group["length"].tolist(), sources, clusters, capacity)
        return group.drop(columns=["__source", "__cluster"])

    return pack


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    length: Column | None = None,
    cluster: Column | None = None,
    group_pieces: int = GROUP_PIECES,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, item, piece, start, length, pack_group, bin, bin_offset: one row per piece of every row.

    Length defaults to the text's words, the cluster to the id.  Item numbers the input rows, so repeated
    rows stay apart; start is the piece's place in its document.  Null sources and clusters conflict with
    nothing.  A row of length zero (null or empty text) has one piece 0 with no group, bin or offset.  An empty
    table gives no rows.  Other columns are not read.  (pack_group, bin) names a bin.
    """
    if capacity < 1 or group_pieces < 1:
        raise ValueError("capacity and group_pieces must be positive")
    size = F.size(words(col(text_col))) if length is None else length
    rows = docs.select(
        col(id_col).alias("doc_id"),
        F.coalesce(size, F.lit(0)).cast("long").alias("__size"),
        F.xxhash64(col(source_col)).alias("__source_key"),
        col(source_col).isNull().alias("__no_source"),
        (col(id_col) if cluster is None else cluster).alias("__cluster_of"),
    ).select(
        "doc_id",
        "__size",
        F.when(~F.col("__no_source"), F.col("__source_key").cast("string")).alias("__source"),
        F.when(F.col("__cluster_of").isNotNull(), F.xxhash64("__cluster_of").cast("string")).alias("__cluster"),
        F.monotonically_increasing_id().alias("item"),
    )
    items = Workspace(docs.sparkSession).materialize(rows, "items")
    pieces = items.select(F.sum(F.ceil(F.col("__size") / capacity)).alias("n")).first()["n"] or 0
    groups = max(1, math.ceil(int(pieces) / group_pieces))
    cut = (
        items.filter("__size > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__size") - 1) / capacity))))
        .withColumn("start", F.col("piece") * capacity)
        .withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("__size") - F.col("start")))
        .withColumn("pack_group", F.pmod(F.xxhash64("item", "piece"), F.lit(groups)))
        .drop("__size")
    )
    kind = dict(items.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item long, piece long, start long, length long, pack_group long, bin long, bin_offset long"
    names = ["doc_id", "item", "piece", "start", "length", "pack_group"]
    placed = cut.select(*names, "__source", "__cluster").groupBy("pack_group").applyInPandas(_pack_group(capacity), schema)
    nothing = F.lit(0).cast("long")
    void = F.lit(None).cast("long")
    empty = items.filter("__size <= 0").select(
        "doc_id", "item", nothing.alias("piece"), nothing.alias("start"), nothing.alias("length"),
        void.alias("pack_group"), void.alias("bin"), void.alias("bin_offset"),
    )
    return placed.unionByName(empty)
