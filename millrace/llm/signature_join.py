"""N-gram Jaccard join by signature trees: links of similar shingle sets, as connected components.

Two documents link when 100 * |A and B| >= percent * |A or B| over their distinct n-word shingles.

1. Texts with equal sets are one class; only its smallest id goes on.
2. Routing.  Linked sets share a shingle among the first size - ceil(t * size) + 1 of any order that all
   sets keep, so a set goes to one tree for each of these.  Frequent shingles come last in the order: each task
   reports what repeats within a window of its texts, and the most frequent HOT_SHINGLES of the sums are
   sent out.  The list steers cost only.
3. Pivots.  Sets with an equal minimum of a random order are compared, by sizes and bitmaps, with the smallest id
   among them.  That ties masses of near copies together in linear time.
4. Trees.  Routing shingles whose sets are all tied already are dropped by a combined (min, max) aggregate; a Bloom filter
   of the others keeps the routes of all other keys from being shuffled again.  Shingles with different
   sets get a signature tree each: leaves are sets by size, a node holds the OR of the bitmaps below and
   their range of sizes.  A tree is traversed against itself level by level, all trees of a batch at once; a pair
   of nodes goes when its sizes exclude a link, when the largest possible overlap, common bits plus the
   fewest tokens hidden behind shared bits, is too small, or when both hold one component only.  Pairs of leaves are
   bounded once more by bitmaps that grow with the sets.  Large trees are cut into blocks that meet in tiles, and
   a tile reports a spanning forest of the pairs that survive (`masses`).
5. What survives connects masses of likely near copies.  Their links are confirmed on the full sets, and the
   components of the confirmed links are the result.

No set is compared with a set that it is known to be connected to, and no list of pairs leaves a task, so a group of
copies costs no square of its size in rows; no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import join_groups
from ..session import Workspace
from .common import col
from .masses import connected, cross_tiles, edge_batch, equal_sets, mass_links, tile_numbers, whole_tiles
from .shingles import mix, shingle_sets

HOT_SHINGLES = 1 << 17
WINDOW_SHINGLES = 1 << 21
WINDOW_REPEATS = 3
PIVOTS = 4
BITS = 1024
PAIR_CHUNK = 1 << 16
KEYS = ("key", "i", "j")
LEADER_SALTS = 64
FILTER_BITS = 1 << 28
FILTER_HASHES = 3


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(flat))


def frequent_shingles(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of at most HOT_SHINGLES shingles that repeat most."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= WINDOW_REPEATS
            return pa.RecordBatch.from_arrays([_signed(found[often]), pa.array(counts[often])], ["shingle", "n"])

        for batch in batches:
            for own in shingle_sets(batch.column("text"), n):
                held.append(own)
                size += len(own)
                if size >= WINDOW_SHINGLES:
                    yield close()
                    held, size = [], 0
        if size:
            yield close()

    sums = texts.select("text").mapInArrow(report, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    sums = Workspace(texts.sparkSession).materialize(sums, "repeating-shingles")
    # The smallest count that leaves no more than the bound: one row per power of two, then exact.
    steps = {r["k"]: r["c"] for r in sums.groupBy(F.floor(F.log2("n") * 8).alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
    taken, least = 0, None
    for k in sorted(steps, reverse=True):
        if taken + steps[k] > HOT_SHINGLES:
            break
        taken, least = taken + steps[k], k
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rows = sums.filter(F.floor(F.log2("n") * 8) >= least).toArrow()
    shingles = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows.column("n").to_numpy()[order]


def _prefix(own: np.ndarray, percent: int, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The routing shingles of a sorted set: rare ones by hash, then frequent ones by count and hash."""
    size = len(own)
    length = size + (-percent * size) // 100 + 1
    if len(hot) == 0:
        return own[:length]
    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
    listed = hot[at] == own
    rare = own[~listed][:length]
    if len(rare) == length:
        return rare
    more, often = own[listed], counts[at[listed]]
    return np.concatenate([rare, more[np.lexsort((more, often))][: length - len(rare)]])


def _bitmap(own: np.ndarray, width: int = BITS) -> bytes:
    """Bits at the top bits of the hashes; width is a power of two."""
    bits = np.zeros(width, dtype=bool)
    bits[(own >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _wide(own: np.ndarray) -> bytes:
    """A bitmap of two bits or more for each shingle; empty where the bitmap of BITS is that large."""
    width = 1 << (2 * len(own) - 1).bit_length()
    return _bitmap(own, width) if width > BITS else b""


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of half the width, and so on down to the size: neighbouring bits are OR-combined."""
    while len(bits) > size:
        bits = np.packbits(np.unpackbits(bits).reshape(-1, 2).any(axis=1))
    return bits


def describe_sets(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """id, size, key1, key2, pivots, prefix, bits, wide of each text's shingle set."""
    hot = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, n))
    salts = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = hot.value
        for batch in batches:
            sizes, sums, xors, pivots, prefixes, bits, wide = [], [], [], [], [], [], []
            for own in shingle_sets(batch.column("text"), n):
                sizes.append(len(own))
                mixed = mix(own ^ salts[0])
                sums.append(int(mixed.sum(dtype=np.uint64)) if len(own) else 0)
                xors.append(int(np.bitwise_xor.reduce(mix(mixed))) if len(own) else 0)
                ways = [mixed, *(mix(own ^ s) for s in salts[1:])]
                pivots.append(np.array([w.min() for w in ways], dtype=np.uint64) if len(own) else own)
                prefixes.append(_prefix(own, percent, frequent, counts) if len(own) else own)
                bits.append(_bitmap(own))
                wide.append(_wide(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(sizes, pa.int64()),
                    _signed(np.array(sums, dtype=np.uint64)), _signed(np.array(xors, dtype=np.uint64)),
                    _lists(pivots), _lists(prefixes), pa.array(bits, pa.binary()),
                    pa.array(wide, pa.binary()),
                ],
                ["id", "size", "key1", "key2", "pivots", "prefix", "bits", "wide"],
            )

    schema = "id long, size long, key1 long, key2 long, pivots array<long>, prefix array<long>, bits binary, wide binary"
    return texts.mapInArrow(describe, schema)


def likely(bits: tuple[list[bytes], list[bytes]], sizes: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Which pairs (bitmap by bitmap, size by size) can link by the most shingles they can have in common."""
    m, n = sizes
    ok = (m * 100 >= percent * n) & (n * 100 >= percent * m)
    widths = [np.array([len(x) for x in side], dtype=np.int64) for side in bits]
    least = np.minimum(*widths)
    for width in np.unique(least[ok]).tolist():
        at = np.flatnonzero(ok & (least == width))
        for start in range(0, len(at), max(1, (1 << 22) // width)):
            part = at[start : start + max(1, (1 << 22) // width)]
            p, q = (np.stack([_folded(np.frombuffer(side[k], dtype=np.uint8), width) for k in part.tolist()]).view(np.uint64) for side in bits)
            most = np.bitwise_count(p & q).sum(axis=1, dtype=np.int64)
            hidden = [own[part] - np.bitwise_count(x).sum(axis=1, dtype=np.int64) for own, x in ((m, p), (n, q))]
            ok[part] = (most + np.minimum(*hidden)) * (100 + percent) >= percent * (m + n)[part]
    return ok


def likely_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that can link, by sizes and bitmaps.

    An a may have many partners; its row is found again by (a, salt), so that no task holds all of them.
    """
    side = lambda k: sets.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("size", "bits", "wide")])
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(LEADER_SALTS)))
    leaders = salted.select("a", "salt").distinct().join(side("a"), "a")
    asked = salted.join(side("b"), "b").join(leaders, ["a", "salt"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c).to_pylist() for c in ("a_bits", "b_bits", "a_wide", "b_wide")}
            bits = tuple([w or x for w, x in zip(column[f"{k}_wide"], column[f"{k}_bits"], strict=True)] for k in "ab")
            sizes = tuple(batch.column(f"{k}_size").to_numpy() for k in "ab")
            yield batch.select(["a", "b"]).filter(pa.array(likely(bits, sizes, percent)))

    return asked.mapInArrow(keep, "a long, b long")


def pivot_pairs(reps: DataFrame, space: Workspace) -> DataFrame:
    """Pairs (a, b) of sets b and the smallest id a of those with an equal minimum."""
    ways = reps.select("id", F.posexplode("pivots").alias("way", "pivot")).select("id", F.xxhash64("way", "pivot").alias("key"))
    groups = ways.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("__size")).filter("__size > 1")
    groups = space.materialize(groups, "pivot-groups")
    total = groups.agg(F.sum("__size").alias("n")).first()["n"] or 0
    return join_groups(ways, groups, "key", total).filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def _levels(tree: np.ndarray, bits: np.ndarray, size: np.ndarray, comp: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Nodes from the leaves up; rows come by tree and size.  Two children to a node, one at an odd end."""
    hidden = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    level = {"tree": tree, "bits": bits, "low": size, "high": size, "hidden": hidden, "first": comp, "last": comp}
    levels = [level]
    while True:
        tree = level["tree"]
        heads = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        if len(heads) == len(tree):
            return levels
        place = np.arange(len(tree)) - np.repeat(heads, np.diff(np.r_[heads, len(tree)]))
        starts = np.flatnonzero(place % 2 == 0)
        level = {
            "tree": tree[starts],
            "bits": np.bitwise_or.reduceat(level["bits"], starts, axis=0),
            "low": np.minimum.reduceat(level["low"], starts),
            "high": np.maximum.reduceat(level["high"], starts),
            "hidden": np.maximum.reduceat(level["hidden"], starts),
            "first": np.minimum.reduceat(level["first"], starts),
            "last": np.maximum.reduceat(level["last"], starts),
            "child": starts,
            "children": np.diff(np.r_[starts, len(tree)]),
        }
        levels.append(level)


def _alive(level: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes can hold a link between different components."""
    low_p, low_q = level["low"][p], level["low"][q]
    tied = (level["first"][p] == level["last"][p]) & (level["first"][q] == level["last"][q])
    tied &= level["first"][p] == level["first"][q]
    ok = ~tied & (level["high"][p] * 100 >= percent * low_q) & (level["high"][q] * 100 >= percent * low_p)
    at = np.flatnonzero(ok)
    for start in range(0, len(at), PAIR_CHUNK):
        part = at[start : start + PAIR_CHUNK]
        a, b = p[part], q[part]
        most = np.bitwise_count(level["bits"][a] & level["bits"][b]).sum(axis=1, dtype=np.int64)
        most += np.minimum(level["hidden"][a], level["hidden"][b])
        ok[part] = most * (100 + percent) >= percent * (level["low"][a] + level["low"][b])
    return ok


def forest_pairs(
    tile: np.ndarray, block: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Rows (in the order given) that survive the dual traversals of all tiles.

    A tile of one block is a tree against itself, a tile of two blocks one tree against the other.
    """
    order = np.lexsort((size, block, tile))
    tile, block = tile[order], block[order]
    tree = np.cumsum(np.r_[True, (tile[1:] != tile[:-1]) | (block[1:] != block[:-1])]) - 1
    levels = _levels(tree, bits[order], size[order], comp[order])
    heads = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    of_tile = tile[heads]
    roots = np.arange(len(heads))
    cross = np.flatnonzero(of_tile[1:] == of_tile[:-1])
    alone = np.ones(len(heads), dtype=bool)
    alone[cross] = alone[cross + 1] = False
    p, q = np.r_[roots[alone], cross], np.r_[roots[alone], cross + 1]
    top = levels[-1]
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        same = p == q
        mixed = level["first"][p] != level["last"][p]
        keep = np.where(same, mixed, False)
        others = np.flatnonzero(~same)
        keep[others] = _alive(level, p[others], q[others], percent)
        p, q = p[keep], q[keep]
        if depth == 0 or len(p) == 0:
            break
        child, count = top["child"] if level is top else level["child"], level["children"]
        lo_p, lo_q, two_p, two_q, same = child[p], child[q], count[p] == 2, count[q] == 2, p == q
        ps = [lo_p, lo_p[two_q], (lo_p + 1)[two_p & ~same], (lo_p + 1)[two_p & two_q]]
        qs = [lo_q, (lo_q + 1)[two_q], lo_q[two_p & ~same], (lo_q + 1)[two_p & two_q]]
        p, q = np.concatenate(ps), np.concatenate(qs)
    return order[p], order[q]


def _spots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of keys in a filter of that many bits (a power of two)."""
    return [(mix(keys ^ salt) & np.uint64(bits - 1)).astype(np.int64) for salt in mix(np.arange(11, 11 + FILTER_HASHES, dtype=np.uint64))]


class KeyFilter:
    """A Bloom filter of the keys of a table, sent to all tasks; 16 bits a key, but FILTER_BITS at most.

    What it lets through holds all the keys.  For more keys than FILTER_BITS / 16 it is fuller, which costs rows, never links.
    """

    def __init__(self, keys: DataFrame):
        bits = self.bits = min(FILTER_BITS, 1 << max(10, (16 * keys.count()).bit_length()))

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spots = np.unique(np.concatenate(_spots(batch.column("key").to_numpy().view(np.uint64), bits)))
                word, first = np.unique(spots >> 6, return_index=True)
                if len(word):
                    own = np.bitwise_or.reduceat(np.uint64(1) << (spots & 63).astype(np.uint64), first)
                    yield pa.RecordBatch.from_arrays([pa.array(word), _signed(own)], ["word", "bits"])

        found = keys.select("key").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        rows = found.toArrow()  # at most FILTER_BITS / 64
        table = np.zeros(bits // 64, dtype=np.uint64)
        table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        self.table = keys.sparkSession.sparkContext.broadcast(table)


def listed_routes(sets: DataFrame, keys: KeyFilter) -> DataFrame:
    """key, id, comp, size of the routes (prefix) of each set whose keys the filter lets through."""
    table, bits = keys.table, keys.bits

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            flat = prefix.flatten().to_numpy()
            rows = np.repeat(np.arange(len(batch)), prefix.value_lengths().to_numpy())
            known = np.ones(len(flat), dtype=bool)
            for spot in _spots(flat.view(np.uint64), bits):
                known &= (table.value[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1
            own = batch.select(["id", "comp", "size"]).take(pa.array(rows[known]))
            yield pa.RecordBatch.from_arrays([pa.array(flat[known]), *own.columns], ["key", "id", "comp", "size"])

    return sets.select("prefix", "id", "comp", "size").mapInArrow(keep, "key long, id long, comp long, size long")


def tree_edges(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (a, b) of the pairs that survive in the trees of each tile (key, i, j, block, id, comp)."""
    sent = tiles.select(*KEYS, "block", "id", "comp").join(sets.select("id", "size", "bits", "wide"), "id")
    sent = sent.repartition(*KEYS).sortWithinPartitions(*KEYS)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_tiles(batches, KEYS):
            block, ids, comp, size = (rows.column(c).to_numpy() for c in ("block", "id", "comp", "size"))
            raw = b"".join(rows.column("bits").to_pylist())
            bits = np.frombuffer(raw, dtype=np.uint64).reshape(len(rows), BITS // 64)
            p, q = forest_pairs(tile_numbers(rows, KEYS), block, size, comp, bits, percent)
            wide = rows.column("wide").to_pylist()
            has = np.array([bool(w) for w in wide])
            keep = np.ones(len(p), dtype=bool)
            both = np.flatnonzero(has[p] & has[q])
            pair = ([wide[k] for k in side[both].tolist()] for side in (p, q))
            keep[both] = likely(tuple(pair), (size[p[both]], size[q[both]]), percent)
            yield edge_batch(ids[p[keep]], ids[q[keep]])

    return sent.mapInArrow(traverse, "a long, b long").filter("a <> b")


def similar_components(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; ids are integers.

    Null and empty texts and texts without words have no shingles and are their own component.  Rows that
    repeat an id are one document: what links to one of them links to all.  Rows without an id get a count and a null
    component.  An empty table gives no rows.  Other columns are not read.
    """
    space = Workspace(docs.sparkSession)
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    sets = space.materialize(describe_sets(texts, n, percent), "sets")
    linked = sets.filter("size > 0 AND id IS NOT NULL")
    texts = texts.filter("id IS NOT NULL")

    equal, reps = equal_sets(sets.filter("size > 0 AND id IS NOT NULL"), space)
    pivots = space.materialize(pivot_pairs(reps, space), "led")
    edges = space.materialize(likely_pairs(pivots, reps, percent), "pivot-edges")
    tied = connected(edges, space).select(F.col("node").alias("id"), "component")
    tied = reps.select("id", "size", "prefix").join(tied, "id", "left").withColumn("comp", F.coalesce("component", "id"))
    # Most routes hold one set.  Keys of the others are found with narrow rows; only their routes are dealt with further.
    mixed = tied.select(F.explode("prefix").alias("key"), "comp").groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = space.materialize(mixed.filter("low <> high"), "mixed-routes")
    routes = space.materialize(listed_routes(tied, KeyFilter(mixed)), "listed-routes")
    route_groups = routes.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("__size"),
        F.min("size").alias("least"), F.max("size").alias("most"), F.min("id").alias("a"), F.max("id").alias("b"),
        *[F.sum(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 31))).alias(f"sum{k}") for k in (1, 2)],
    )
    # Two sets alone on a route must at least have sizes that can link.
    apart = (F.col("__size") == 2) & (F.col("least") * 100 < F.col("most") * percent)
    route_groups = route_groups.filter((F.col("low") != F.col("high")) & ~apart).drop("least", "most")
    route_groups = space.materialize(route_groups.withColumn("__weight", F.lit(0).cast("long")), "route-groups")
    # A tree of two leaves is one pair, which the aggregate names; it is looked at once for all routes it shares.
    pairs = space.materialize(route_groups.filter("__size = 2 AND a <> b").select("a", "b").distinct(), "route-pairs")
    edges = edges.unionByName(space.materialize(likely_pairs(pairs, reps, percent), "pair-edges"))
    # Routes with the same sets, as a shared passage makes them, have the same tree; one of them is enough.
    row = F.min(F.struct("key", "low", "high", "__weight")).alias("row")
    trees = route_groups.filter("__size > 2").groupBy("__size", "a", "b", "sum1", "sum2").agg(row).select("__size", "row.*")
    tiles = cross_tiles(routes.select("key", "id", "comp"), space.materialize(trees, "trees"), space)
    edges = edges.unionByName(space.materialize(tree_edges(tiles, reps, percent), "tree-edges"))
    links = mass_links(edges, reps, texts, n, percent, space)
    found = connected(equal.unionByName(links), space)
    return sets.join(found, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"),
    )
