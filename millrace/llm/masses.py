"""Groups whose members have to be compared with each other, met in tiles of bounded size.

A group (a bucket, a route, a mass of likely near copies) of more than TILE members, or of more than TILE_WEIGHT
shingles, is dealt to blocks.  First each block meets itself, which costs no more than the group has rows and joins
most of what belongs together.  Then blocks meet in pairs, but members that are known to be connected
to the group's smallest component meet only the others, never each other.  A tile reports the edges of a spanning forest,
so what leaves it is never more than what came in, however many pairs it holds.

Members are joined with one row per group by a sort-merge join at every size of the table; a group with very many members
makes such a join uneven, not large, and adaptive execution splits it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, join_groups, small
from ..session import Workspace
from .shingles import shingle_sets

TILE = 512
TILE_WEIGHT = 1 << 22
TABLE_ROWS = 20_000
EDGES = 1 << 20
MATRIX = 1 << 22  # cells of a part of the matrix of sets and shingles


def spanning(p: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of edges (p, q) between numbers below n that form a spanning forest, and the least number tied to each."""
    label, places, chosen = np.arange(n), np.arange(len(p)), []
    while True:
        a, b = label[p[places]], label[q[places]]
        apart = a != b
        places = places[apart]
        if len(places) == 0:
            return np.sort(np.concatenate(chosen)) if chosen else places, label
        high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        roots, first = np.unique(high, return_index=True)  # each larger root is tied to one smaller root
        chosen.append(places[first])
        label[roots] = low[first]
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of the edges between the ids a and b."""
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    keep, _ = spanning(where[: len(a)], where[len(a) :], len(ids))
    return pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], ["a", "b"])


def connected(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Tasks of about EDGES edges contract what they hold to stars.  If there is more than one of them, stars that
    share nodes are joined by `components`.
    """
    edges = space.materialize(edges.select("a", "b"), "edges")
    tasks = max(1, math.ceil(edges.count() / EDGES))
    dealt = edges.repartition(1) if tasks == 1 else edges.repartition(tasks, F.greatest("a", "b"))

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        ids, where = np.unique(np.concatenate([table.column(c).to_numpy() for c in "ab"]), return_inverse=True)
        _, label = spanning(where[: len(table)], where[len(table) :], len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["node", "component"])

    stars = space.materialize(dealt.mapInArrow(contract, "node long, component long"), "stars")
    return stars if tasks == 1 else components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")), space)


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = TABLE_ROWS) -> Iterator[pa.Table]:
    """Tables of whole tiles, with about the given number of rows; the batches come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(len(table), dtype=bool)
        for key in keys:
            column = table.column(key).to_numpy()
            last &= column == column[-1]
        cut = int(last.argmax())  # the last tile may go on in the next batch
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut).to_batches()
        size = len(table) - cut
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def tile_numbers(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Numbers of the tiles of a sorted table, from 0."""
    new = np.zeros(len(table), dtype=bool)
    for key in keys:
        column = table.column(key).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def group_sizes(members: DataFrame, weight: str | None = None) -> DataFrame:
    """key, __size, __weight, low, high of the groups of two members and more (of key, id, comp)."""
    total = F.sum(weight) if weight else F.lit(0).cast("long")
    groups = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("__size"), total.alias("__weight"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    return groups.filter("__size > 1")


def _blocks(size: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(size / TILE), F.ceil(weight / TILE_WEIGHT)).cast("long")


def _total(groups: DataFrame) -> int:
    return groups.agg(F.sum("__size").alias("n")).first()["n"] or 0


def diagonal_tiles(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members' columns with i and j: every block of every group, to meet itself."""
    joined = members.join(groups.select("key", "__size", "__weight").hint("merge"), "key")
    block = F.pmod(F.xxhash64("key", "id"), _blocks(F.col("__size"), F.col("__weight")))
    return joined.withColumns({"i": block, "j": block}).drop("__size", "__weight")


def cross_tiles(members: DataFrame, groups: DataFrame, space: Workspace, weight: str | None = None) -> DataFrame:
    """The members' columns with block, i and j: tiles in which all pairs of different comp meet.

    groups must hold more than one component each.  Members of the smallest one do not meet each other in groups of
    more than one block.
    """
    large = space.materialize(groups.filter(_blocks(F.col("__size"), F.col("__weight")) > 1), "large-groups")
    inside = members.join(large.select("key", "low"), "key").filter(F.col("comp") == F.col("low"))
    mass = F.sum(weight) if weight else F.lit(0).cast("long")
    mains = inside.groupBy("key").agg(F.count(F.lit(1)).alias("mains"), mass.alias("main_weight"))
    mains = space.materialize(mains, "main-parts")
    own = groups.join(mains, "key", "left")
    rest = _blocks(F.col("__size") - F.coalesce("mains", F.lit(0)), F.col("__weight") - F.coalesce("main_weight", F.lit(0)))
    own = own.select(
        "key", "__size", "low", F.greatest(rest, F.lit(1)).alias("others"),
        F.coalesce(_blocks(F.col("mains"), F.col("main_weight")), F.lit(0).cast("long")).alias("main_blocks"),
    )
    joined = members.join(own.hint("merge"), "key")
    main = (F.col("main_blocks") > 0) & (F.col("comp") == F.col("low"))
    others, every = F.col("others"), F.col("others") + F.col("main_blocks")
    spot = F.xxhash64("key", "id")
    block = F.when(main, others + F.pmod(spot, F.col("main_blocks"))).otherwise(F.pmod(spot, others))
    partners = F.sequence(F.lit(0).cast("long"), F.when(main, others).otherwise(every) - 1)
    met = joined.withColumn("block", block).withColumn("other", F.explode(partners))
    met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return met.drop("__size", "low", "others", "main_blocks", "other")


def equal_sets(sets: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that tie ids of equal sets to the smallest of them, and the sets without these others.

    sets has id and the size and two hashes of a set in size, key1, key2.
    """
    keys = ["size", "key1", "key2"]
    classes = sets.groupBy(*keys).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("__size"))
    classes = space.materialize(classes.filter("__size > 1").withColumn("key", F.xxhash64(*keys)), "classes")
    keyed = sets.select("id", F.xxhash64(*keys).alias("key"))
    equal = join_groups(keyed, classes.select("key", "rep", "__size"), "key", _total(classes)).filter("id <> rep")
    equal = space.materialize(equal.select(F.col("rep").alias("a"), F.col("id").alias("b"), "key"), "equal")
    # Of an id that repeats with other texts only the rows of this set go.
    gone = equal.select(F.col("b").alias("id"), "key").distinct()
    reps = sets.withColumn("key", F.xxhash64(*keys)).join(gone, ["id", "key"], "left_anti").drop("key")
    return equal.select("a", "b").distinct(), space.materialize(reps, "representatives")


def linked_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sorted sets that link, by a product of the matrix of sets and shared shingles with itself."""
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    same = flat[1:] == flat[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    column = np.cumsum(np.r_[True, ~same])[shared]
    owner = owner[shared]
    common = np.zeros((n, n))
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        width = max(1, MATRIX // n)
        for start in range(0, int(column[-1]) + 1, width):
            low, high = np.searchsorted(column, [start, start + width])
            part = np.zeros((n, min(width, int(column[-1]) + 1 - start)), dtype=np.float32)
            part[owner[low:high], column[low:high] - start] = 1
            common += part @ part.T
    links = common * 100 >= percent * (sizes[:, None] + sizes[None, :] - common)
    return np.nonzero(np.triu(links, 1))


def met_links(tiles: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Spanning links (a, b) of the full sets of each tile (key, i, j, id); tiles should be a written table."""
    keys = ("key", "i", "j")
    sent = texts.join(small(tiles.select(*keys, "id")), "id").repartition(*keys).sortWithinPartitions(*keys)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        ids: list[int] = []
        sets: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            p, q = linked_pairs(sets, percent)
            own = np.array(ids, dtype=np.int64)
            return edge_batch(own[p], own[q])

        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in (*keys, "id")], shingle_sets(batch.column("text"), n), strict=True)
            for *tile, own_id, own in rows:
                if tile != now:
                    if len(ids) > 1:
                        yield close()
                    now, ids, sets = tile, [], []
                ids.append(own_id)
                sets.append(own)
        if len(ids) > 1:
            yield close()

    return sent.mapInArrow(check, "a long, b long").filter("a <> b")


def mass_links(edges: DataFrame, sets: DataFrame, texts: DataFrame, n: int, percent: int, space: Workspace) -> DataFrame:
    """Verified links (a, b) that connect all that links; edges span the pairs that may link.

    What edges connect is a mass; each of its texts is sent once where the mass fits one tile, and all pairs inside are
    checked by their full sets.  sets has id and size, texts id and text.
    """
    weights = sets.groupBy("id").agg(F.sum("size").alias("size"))
    masses = connected(edges, space)
    members = masses.select(F.col("component").alias("key"), F.col("node").alias("id")).join(weights, "id")
    members = space.materialize(members.withColumn("comp", F.col("id")), "masses")
    groups = space.materialize(group_sizes(members, "size"), "mass-sizes")
    first = space.materialize(met_links(space.materialize(diagonal_tiles(members, groups), "mass-tiles"), texts, n, percent), "links")
    large = groups.filter(_blocks(F.col("__size"), F.col("__weight")) > 1)
    if large.isEmpty():
        return first
    found = connected(first, space).select(F.col("node").alias("id"), F.col("component").alias("found"))
    members = members.join(found, "id", "left").withColumn("comp", F.coalesce("found", "comp")).drop("found")
    members = space.materialize(members, "tied-masses")
    groups = group_sizes(members, "size").filter("low <> high")
    groups = space.materialize(groups.filter(_blocks(F.col("__size"), F.col("__weight")) > 1), "open-masses")
    crossed = space.materialize(cross_tiles(members, groups, space, "size"), "crossed-masses")
    return first.unionByName(space.materialize(met_links(crossed, texts, n, percent), "cross-links"))
