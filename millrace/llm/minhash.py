"""MinHash near-dedup with b-bit signatures: components of documents whose shingle sets are similar.

Two documents link when 100 * |A and B| >= percent * |A or B| over their distinct n-word shingles.

1. HASHES minima of the shingles are taken per document.  Groups of ROWS of them (fewer for low similarities) are its band keys, as many
   as it takes to lose a linking pair with a chance of LOSS at most.  Of all minima the low BITS bits, after mixing, are
   packed to a signature.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Documents that share a band key meet in tiles.  Equal bit groups of two signatures are counted by
   word operations on all pairs of a tile; a similarity of s gives s + (1 - s) / 2^BITS of them, so the count stands
   for a similarity corrected for chance hits.  A pair goes on when a linking pair has that count or less with a
   chance above LOSS.  Each tile reports a spanning forest of such pairs.
4. What these connect is a mass of likely near copies; its links are confirmed on the full sets (`masses`), and the
   components of the confirmed links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from . import masses
from .common import col
from .masses import connected, cross_tiles, diagonal_tiles, edge_batch, equal_sets, group_sizes, mass_links, tile_numbers, whole_tiles
from .shingles import mix, shingle_sets

HASHES = 256
ROWS = 5
BITS = 2
LOSS = 1e-8
CHUNK = 1 << 16  # shingles whose minima are taken together
PAIRS = 1 << 16
KEYS = ("key", "i", "j")

_FACTORS = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_TERMS = (mix(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def band_layout(percent: int) -> tuple[int, int]:
    """Bands and minima a band: a linking pair misses all bands with a chance of LOSS at most."""
    for rows in range(ROWS, 0, -1):
        same = (percent / 100) ** rows
        bands = 1 if same >= 1 else math.ceil(math.log(LOSS) / math.log1p(-same)) if same > 0 else HASHES + 1
        if bands * rows <= HASHES:
            return bands, rows
    raise ValueError(f"{HASHES} hashes are too few for a similarity of {percent} percent")


def least_matches(percent: int) -> int:
    """The largest count that a pair of exactly percent similarity stays under with a chance of LOSS at most."""
    p = percent / 100 + (1 - percent / 100) / (1 << BITS)
    if p >= 1:
        return HASHES
    below = 0.0
    for k in range(HASHES + 1):
        ways = math.lgamma(HASHES + 1) - math.lgamma(k + 1) - math.lgamma(HASHES - k + 1)
        below += math.exp(ways + k * math.log(p) + (HASHES - k) * math.log1p(-p))
        if below > LOSS:
            return k
    return HASHES


def estimate(matches: float) -> float:
    """The similarity that a count of equal bit groups stands for."""
    chance = 1 / (1 << BITS)
    return (matches / HASHES - chance) / (1 - chance)


def minima(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES minima of each stretch of shingle hashes; no stretch is empty."""
    short = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), HASHES), dtype=np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(short * _FACTORS[k] + _TERMS[k], starts)
    return out


def signatures(least: np.ndarray) -> np.ndarray:
    """The packed low bits of the mixed minima, one row of 64-bit words a document."""
    low = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    bits = (low[:, :, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.reshape(len(low), -1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def matches(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Equal bit groups of signatures, row by row."""
    differ = one ^ two
    for step in range(1, BITS):
        differ = differ | ((one ^ two) >> np.uint64(step))
    mask = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    return HASHES - np.bitwise_count(differ & mask).sum(axis=1, dtype=np.int64)


def describe(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """id, size, key1, key2, bands, signature of each text's shingle set."""
    bands, rows = band_layout(percent)
    salts = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(sets), bands), dtype=np.uint64)
            packed = np.zeros((len(sets), HASHES * BITS // 64), dtype=np.uint64)
            sums, xors = np.zeros((2, len(sets)), dtype=np.uint64)
            if len(full):
                flat, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
                least = minima(flat, starts)
                mixed = least[:, : bands * rows].astype(np.uint64) * salts
                keys[full] = mix(mixed.reshape(len(full), bands, rows).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                packed[full] = signatures(least)
                other = mix(flat ^ salts[0])
                sums[full], xors[full] = np.add.reduceat(other, starts), np.bitwise_xor.reduceat(mix(other), starts)
            filled = np.where(sizes > 0, bands, 0)
            offsets = pa.array(np.r_[0, np.cumsum(filled)].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys[full].ravel().view(np.int64)))
            columns = [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(sums.view(np.int64)), pa.array(xors.view(np.int64))]
            signs = pa.array([row.tobytes() for row in packed], pa.binary())
            return pa.RecordBatch.from_arrays([*columns, lists, signs], ["id", "size", "key1", "key2", "bands", "signature"])

        for batch in batches:
            ids, sets, size = [], [], 0
            for own_id, own in zip(batch.column("id").to_pylist(), shingle_sets(batch.column("text"), n), strict=True):
                ids.append(own_id)
                sets.append(own)
                size += len(own)
                if size > CHUNK:
                    yield part(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield part(ids, sets)

    return texts.mapInArrow(work, "id long, size long, key1 long, key2 long, bands array<long>, signature binary")


def tile_pairs(tile: np.ndarray, signs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one tile with so many equal bit groups; rows come by tile."""
    ends = np.searchsorted(tile, tile, side="right")
    p, step, found = np.arange(len(tile)), 0, []
    while True:
        step += 1
        p = p[p + step < ends[p]]
        if len(p) == 0:
            break
        for start in range(0, len(p), PAIRS):
            own = p[start : start + PAIRS]
            own = own[matches(signs[own], signs[own + step]) >= least]
            found.append((own, own + step))
    if not found:
        return p, p
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def likely_edges(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (a, b) of the pairs of each tile (key, i, j, id) that may link."""
    least, words = least_matches(percent), HASHES * BITS // 64
    sent = tiles.select(*KEYS, "id").join(sets.select("id", "signature"), "id")
    sent = sent.repartition(*KEYS).sortWithinPartitions(*KEYS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches, KEYS):
            raw = b"".join(table.column("signature").to_pylist())
            signs = np.frombuffer(raw, dtype=np.uint64).reshape(len(table), words)
            p, q = tile_pairs(tile_numbers(table, KEYS), signs, least)
            ids = table.column("id").to_numpy()
            yield edge_batch(ids[p], ids[q])

    return sent.mapInArrow(meet, "a long, b long").filter("a <> b")


def near_copies(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; ids are integers.

    A document is kept when it is the smallest of its component.  Null and empty texts and texts without words have no
    shingles and are their own component.  Rows that repeat an id are one document: what links to one of them links to
    all.  Rows without an id get a count, a null component and a null verdict.  An empty table gives no rows.
    Other columns are not read.
    """
    space = Workspace(docs.sparkSession)
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    sets = space.materialize(describe(texts, n, percent), "signatures")
    equal, reps = equal_sets(sets.filter("size > 0 AND id IS NOT NULL"), space)

    members = reps.select(F.explode("bands").alias("key"), "id", F.col("id").alias("comp"))
    groups = space.materialize(group_sizes(members).drop("low", "high"), "buckets")
    edges = space.materialize(likely_edges(diagonal_tiles(members, groups), reps, percent), "likely")
    tied = connected(edges, space).select(F.col("node").alias("id"), "component")
    # Buckets of more than one block: their blocks meet where they hold more than one mass.
    members = reps.join(tied, "id", "left").select(F.explode("bands").alias("key"), "id", F.coalesce("component", "id").alias("comp"))
    open_ = members.join(groups.filter(F.col("__size") > masses.TILE).select("key"), "key", "left_semi")
    groups = space.materialize(group_sizes(open_).filter("low <> high"), "open-buckets")
    if not groups.isEmpty():
        more = likely_edges(cross_tiles(members, groups, space), reps, percent)
        edges = edges.unionByName(space.materialize(more, "likely-across"))
    links = mass_links(edges, reps, texts.filter("id IS NOT NULL"), n, percent, space)
    found = connected(equal.unionByName(links), space)
    component = F.when(F.col("size") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return sets.join(found, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), component.alias("component_id"), (component == F.col("id")).alias("kept")
    )
