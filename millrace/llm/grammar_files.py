"""Token-id files compressed by a Re-Pair grammar per block, with random access.

Documents are written in id order.  A shard (one task's range of ids) is a run of blocks of about BLOCK_TOKENS
ids, each with a grammar of its own.  Re-Pair is run in rounds: the most frequent pairs of a block become
nonterminals together (in a run of overlapping occurrences every second one is replaced), until no pair
is frequent or the nonterminals are used up.  No pair reaches over the end of a document, so each document is
a range of symbols of its own.

A block is one row of a Parquet table:
  shard, block, block_start (ids before the block in its shard), doc_ids,
  doc_tokens and doc_symbols (where each document begins, in ids and in symbols, one more than documents),
  left, right (the rules, numbered from first_rule), rule_lengths (ids that each rule stands for), symbols.
Numbers are little-endian, symbols and rules of `width` bytes, the others of 8.  Any range of a document is
decoded from the lengths of its symbols without touching the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col
from .encoding import Encoder, flat_lists, gather, joined

BLOCK_TOKENS = 1 << 19
RULES_A_ROUND = 1536
LEAST_COUNT = 6
BLOCK_SCHEMA = (
    "shard long, block long, block_start long, width int, first_rule long, doc_ids array<long>, doc_tokens binary, "
    "doc_symbols binary, left binary, right binary, rule_lengths binary, symbols binary"
)


def build_grammar(
    symbols: np.ndarray, ends: np.ndarray, first_rule: int, most_rules: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left and right sides of the rules, the remaining symbols, and the places of those that end a document."""
    symbols, ends = symbols.astype(np.uint32), ends.astype(np.int64)
    narrow = first_rule + most_rules < 1 << 16
    kind, shift = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
    none = kind(np.iinfo(kind).max)  # no pair: it reaches over an end
    lefts, rights, rules = [], [], 0
    code_of_left, code_of_right = np.zeros((2, first_rule + most_rules), dtype=np.int16)
    while True:
        room = min(RULES_A_ROUND, most_rules - rules)
        if len(symbols) <= LEAST_COUNT or room <= 0:
            break
        pairs = (symbols[:-1].astype(kind) << shift) | symbols[1:].astype(kind)
        closed = ends[ends < len(pairs)]
        pairs[closed] = none
        pairs.sort()
        # Where a pair's LEAST_COUNT-th occurrence from here is the same: one stretch for each frequent pair.
        again = np.zeros(len(pairs) - LEAST_COUNT + 3, dtype=bool)
        np.equal(pairs[LEAST_COUNT - 1 :], pairs[: len(pairs) - LEAST_COUNT + 1], out=again[1:-1])
        edges = np.flatnonzero(again[1:] != again[:-1])
        distinct, counts = pairs[edges[::2]], edges[1::2] - edges[::2] + LEAST_COUNT - 1
        if len(distinct) and distinct[-1] == none:
            distinct, counts = distinct[:-1], counts[:-1]
        if len(distinct) == 0:
            break
        if len(distinct) > room:
            distinct = np.sort(distinct[np.argpartition(-counts, room - 1)[:room]])
        left, right = (distinct >> shift).astype(np.uint32), (distinct & kind((1 << int(shift)) - 1)).astype(np.uint32)
        # Small codes of the sides, 0 for symbols that are none, lead to the rule in one table.
        (own_left, rows), (own_right, cols) = np.unique(left, return_inverse=True), np.unique(right, return_inverse=True)
        code_of_left[own_left], code_of_right[own_right] = np.arange(1, len(own_left) + 1), np.arange(1, len(own_right) + 1)
        width = np.int32(len(own_right) + 1)
        table = np.full((len(own_left) + 1) * int(width), -1, dtype=np.int16)
        table[(rows + 1) * width + cols + 1] = np.arange(len(distinct))
        spots = symbols.astype(np.intp)
        first, second = code_of_left.take(spots[:-1], mode="clip"), code_of_right.take(spots[1:], mode="clip")
        first[closed] = 0
        at = np.flatnonzero((first != 0) & (second != 0))
        rule = table.take(first[at].astype(np.intp) * width + second[at], mode="clip")
        known = rule >= 0
        at, rule = at[known], rule[known]
        code_of_left[own_left] = code_of_right[own_right] = 0
        # Of occurrences that overlap in a run, every second one is taken.
        place = np.arange(len(at), dtype=np.int32)
        even = (place - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))) & 1 == 0
        at, taken = at[even], rule[even]
        # Pairs of which others took every occurrence get no rule, so there are no more rules than symbols replaced.
        used = np.flatnonzero(np.bincount(taken, minlength=len(distinct)))
        numbers = np.zeros(len(distinct), dtype=np.uint32)
        numbers[used] = np.arange(first_rule + rules, first_rule + rules + len(used))
        left, right = left[used], right[used]
        symbols[at] = numbers[taken]
        stay = np.ones(len(symbols), dtype=bool)
        stay[at + 1] = False
        symbols = symbols[stay]
        ends = ends - np.searchsorted(at + 1, ends, side="right")
        lefts.append(left)
        rights.append(right)
        rules += len(used)
    nothing = np.zeros(0, dtype=np.uint32)
    return np.concatenate(lefts or [nothing]), np.concatenate(rights or [nothing]), symbols, ends


def expansions(left: np.ndarray, right: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray]:
    """What each rule stands for, one after the other, and where each begins (one more than rules)."""
    flat = np.stack([left, right], axis=1).reshape(-1).astype(np.int64)
    bounds = np.arange(0, len(flat) + 1, 2)
    both = np.stack([left, right], axis=1).reshape(-1).astype(np.int64)
    while (nested := flat >= first_rule).any():
        # Each nonterminal gives way to its two sides.
        sizes = 1 + nested
        ends = np.cumsum(sizes)
        grown = np.empty(int(ends[-1]), dtype=np.int64)
        grown[ends - sizes] = np.where(nested, both[2 * (flat - first_rule) * nested], flat)
        grown[ends[nested] - 1] = both[2 * (flat[nested] - first_rule) + 1]
        bounds = np.r_[0, ends][bounds]
        flat = grown
    return flat, bounds


class Block:
    """One block as read back."""

    def __init__(self, row: dict):
        kind = np.dtype(f"<u{row['width']}")
        self.first_rule, self.doc_ids = row["first_rule"], row["doc_ids"]
        self.doc_tokens = np.frombuffer(row["doc_tokens"], dtype="<i8")
        self.doc_symbols = np.frombuffer(row["doc_symbols"], dtype="<i8")
        self.symbols = np.frombuffer(row["symbols"], dtype=kind).astype(np.int64)
        left, right = np.frombuffer(row["left"], dtype=kind), np.frombuffer(row["right"], dtype=kind)
        flat, bounds = expansions(left, right, self.first_rule)
        self.flat = np.r_[np.arange(self.first_rule), flat]
        self.starts = np.r_[np.arange(self.first_rule), self.first_rule + bounds[:-1]]
        self.lengths = np.r_[np.ones(self.first_rule, dtype=np.int64), np.frombuffer(row["rule_lengths"], dtype="<i8")]

    def tokens(self) -> np.ndarray:
        """All ids of the block."""
        return gather(self.flat, self.starts[self.symbols], self.lengths[self.symbols])

    def document(self, number: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the block's document of that number; only their symbols are expanded."""
        own = self.symbols[self.doc_symbols[number] : self.doc_symbols[number + 1]]
        ends = np.cumsum(self.lengths[own])
        size = int(ends[-1]) if len(ends) else 0
        start, stop, _ = slice(start, stop).indices(size)
        if start >= stop:
            return np.zeros(0, dtype=np.int64)
        one, two = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
        part = own[one : two + 1]
        skip = start - (int(ends[one - 1]) if one else 0)
        return gather(self.flat, self.starts[part], self.lengths[part])[skip : skip + stop - start]


def _block(shard: int, number: int, start: int, ids: list[int], parts: list[np.ndarray], vocabulary: int) -> dict:
    tokens, bounds = flat_lists(parts, np.uint32)
    width = 2 if vocabulary < (1 << 16) - 1 else 4
    most = min((1 << 8 * width) - 1 - vocabulary, len(tokens))
    left, right, symbols, ends = build_grammar(tokens, bounds[1:] - 1, vocabulary, most)
    _, rules = expansions(left, right, vocabulary)
    kind = np.dtype(f"<u{width}")
    return {
        "shard": shard, "block": number, "block_start": start, "width": width, "first_rule": vocabulary, "doc_ids": ids,
        "doc_tokens": bounds.astype("<i8").tobytes(),
        "doc_symbols": np.r_[0, ends + 1].astype("<i8").tobytes(),
        "left": left.astype(kind).tobytes(), "right": right.astype(kind).tobytes(),
        "rule_lengths": np.diff(rules).astype("<i8").tobytes(), "symbols": symbols.astype(kind).tobytes(),
    }


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"shard": pa.int64(), "block": pa.int64(), "block_start": pa.int64(), "width": pa.int32(), "first_rule": pa.int64(), "doc_ids": pa.list_(pa.int64())}
    names = [c.strip().split(" ")[0] for c in BLOCK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.binary())) for c in names], names)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes every text, appends end_id to each, and writes the blocks in id order.

    Null text is empty and has the end id alone.  Null ids come first; rows that repeat an id are written one after
    the other, by text.  An empty table writes no block.  Other columns are not read.  Ids are integers.
    """
    ordered = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        parts: list[np.ndarray] = []
        size = 0
        end = np.array([end_id], dtype=np.uint32)
        for batch in joined(batches, "text"):
            tokens, bounds = encoder.encode(batch.column("text"))
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids.append(doc_id)
                parts.append(np.concatenate([tokens[bounds[i] : bounds[i + 1]], end]))
                size += len(parts[-1])
                if size >= BLOCK_TOKENS:
                    yield _arrow([_block(shard, number, start, ids, parts, encoder.vocabulary)])
                    number, start, ids, parts, size = number + 1, start + size, [], [], 0
        if ids:
            yield _arrow([_block(shard, number, start, ids, parts, encoder.vocabulary)])

    ordered.mapInArrow(write, BLOCK_SCHEMA).write.mode("error").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files."""
    blocks = spark.read.parquet(path)
    shards = blocks.select("shard", "block_start", "doc_tokens").mapInArrow(_block_ends, "shard long, stop long")
    totals = {r["shard"]: r["stop"] for r in shards.groupBy("shard").agg(F.max("stop").alias("stop")).collect()}
    starts, before = [], 0
    for shard in sorted(totals):  # one number per shard
        starts.append((shard, before))
        before += totals[shard]
    offsets = spark.createDataFrame(starts, "shard long, shard_start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                raw = memoryview(block.tokens().astype("<u4").tobytes())
                cuts = block.doc_tokens
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                first = row["shard_start"] + row["block_start"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.doc_ids, pa.int64()), pa.array(first + cuts[:-1], pa.int64()),
                        pa.array(np.diff(cuts), pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = blocks.join(F.broadcast(offsets), "shard")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lasts = [int(np.frombuffer(x, dtype="<i8")[-1]) for x in batch.column("doc_tokens").to_pylist()]
        stops = pa.array(np.array(lasts, dtype=np.int64) + batch.column("block_start").to_numpy(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("shard"), stops], ["shard", "stop"])
