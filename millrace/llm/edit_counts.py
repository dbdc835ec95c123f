"""Token counts that follow edits: only what an edit touches is encoded again.

A document is cut into pre-token segments (see `encoding`), and a segment tree holds their token
counts.  `build_trees` writes both down once, as a table.  `apply_edits` reads that table: an edit replaces a range of
characters; the segments it touches and one on either side are encoded again, as the cuts before and behind
that stretch keep their neighbouring characters, so they stay cuts, and what lies beyond them keeps its tokens.  The
stretch's new count goes to its first leaf, its other leaves become zero, and the sums above them are updated; the root
is the document's count.  All trees of a batch are built and updated together, level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .common import col
from .encoding import Encoder, joined, text_bytes
from .shingles import BLANK_BYTES

EDITS = "array<struct<start:int,stop:int,text:string>>"
Edits = tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]  # document, start, stop, replacement
OUTPUT = ("n_tokens_before", "n_tokens", "n_edits", "n_segments", "n_encoded_again")


class Forest:
    """Binary sum trees over the leaves of many documents; a tree lies in `nodes` level by level, its root last."""

    def __init__(self, leaves: np.ndarray):
        """The number of leaves of each document, at least one."""
        self.sizes = [leaves]
        while (self.sizes[-1] > 1).any():
            below = self.sizes[-1]
            self.sizes.append(np.where(below > 1, (below + 1) // 2, 0))
        totals = np.sum(self.sizes, axis=0, dtype=np.int64)
        self.bounds = np.r_[0, np.cumsum(totals)]
        self.starts = self.bounds[:-1] + np.r_[np.zeros((1, len(leaves)), np.int64), np.cumsum(self.sizes, axis=0)[:-1]]
        self.nodes = np.zeros(int(self.bounds[-1]), dtype=np.int64)

    @property
    def roots(self) -> np.ndarray:
        return self.nodes[self.bounds[1:] - 1]

    def fill(self, values: np.ndarray) -> Forest:
        """Sets all leaves, document by document, and all sums."""
        docs = np.repeat(np.arange(len(self.sizes[0])), self.sizes[0])
        places = np.arange(len(docs)) - np.repeat(np.cumsum(self.sizes[0]) - self.sizes[0], self.sizes[0])
        return self.update(docs, places, values)

    def update(self, docs: np.ndarray, places: np.ndarray, values: np.ndarray) -> Forest:
        """Sets leaves, which come by document and place, and renews the sums above them, and no others."""
        self.nodes[self.starts[0][docs] + places] = values
        for level in range(len(self.sizes) - 1):
            up = self.sizes[level + 1][docs] > 0
            docs, places = docs[up], places[up] // 2
            if len(docs) == 0:
                break
            first = np.r_[True, (docs[1:] != docs[:-1]) | (places[1:] != places[:-1])]
            docs, places = docs[first], places[first]
            left = self.starts[level][docs] + 2 * places
            paired = 2 * places + 1 < self.sizes[level][docs]
            sums = self.nodes[left]
            sums[paired] += self.nodes[left[paired] + 1]
            self.nodes[self.starts[level + 1][docs] + places] = sums
        return self


def _packed(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Stretches of numbers as little-endian 32-bit integers in binary cells, which pass the engine uninspected."""
    offsets, data = pa.py_buffer(np.asarray(4 * bounds, dtype="<i8")), pa.py_buffer(flat.astype("<i4"))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, data]).cast(pa.binary())


def _unpacked(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = text_bytes(cells)
    return np.frombuffer(data.tobytes(), dtype="<i4").astype(np.int64), bounds // 4


def build_trees(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """doc_id, text, sizes (code points of each segment), tree (token counts of segments, then sums level by level, the
    root last), and edits if a column of them is named.  sizes and tree are packed 32-bit integers."""
    edits = [col(edits_col).cast(EDITS).alias("edits")] if edits_col else []
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), *edits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in joined(batches, "text"):
            offsets, sizes, counts = encoder.counts(batch.column("text"))
            empty = np.flatnonzero(np.diff(offsets) == 0)  # one segment without tokens
            sizes, counts = (np.insert(x, offsets[empty], 0) for x in (sizes, counts))
            leaves = np.maximum(np.diff(offsets), 1)
            forest = Forest(leaves).fill(counts)
            packed = [_packed(sizes, np.r_[0, np.cumsum(leaves)]), _packed(forest.nodes, forest.bounds)]
            own = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*own, *packed], [*batch.schema.names, "sizes", "tree"])

    kind = dict(rows.dtypes)["doc_id"]
    more = f", edits {EDITS}" if edits_col else ""
    return rows.mapInArrow(build, f"doc_id {kind}, text string{more}, sizes binary, tree binary")


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All items of list cells and where each cell begins; null is an empty list."""
    sizes = np.where(lists.is_valid(), lists.value_lengths().fill_null(0).to_numpy(), 0)
    return lists.flatten(), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def listed_edits(edits: pa.Array, texts: pa.Array, ends: np.ndarray) -> Edits:
    """The edits of a column that count, by document and start.

    Edits without a start or stop are left out, the others are cut to the text (of ends[i] code points); one that
    overlaps an earlier one is left out.
    """
    flat, bounds = _flat(edits)
    docs = np.repeat(np.arange(len(ends)), np.diff(bounds))
    known = np.array(flat.is_valid(), dtype=bool)
    for c in ("start", "stop"):
        known &= np.array(flat.field(c).is_valid(), dtype=bool)
    start, stop = (flat.field(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "stop"))
    rows = np.flatnonzero(known)
    docs, start, stop = docs[rows], start[rows], stop[rows]
    start, stop = np.clip(start, 0, ends[docs]), np.minimum(stop, ends[docs])
    order = np.lexsort((stop, start, docs))
    order = order[stop[order] >= start[order]]
    docs, start, stop, rows = docs[order], start[order], stop[order], rows[order]
    clash = (docs[1:] == docs[:-1]) & (start[1:] < stop[:-1])
    if clash.any():
        keep, last = np.ones(len(docs), dtype=bool), (-1, 0)
        for k, (doc, a, b) in enumerate(zip(docs.tolist(), start.tolist(), stop.tolist(), strict=True)):
            keep[k] = doc != last[0] or a >= last[1]
            last = (doc, b) if keep[k] else last
        docs, start, stop, rows = docs[keep], start[keep], stop[keep], rows[keep]
    return docs, start, stop, flat.field("text").take(pa.array(rows)).fill_null("").to_pylist()


def numbers_and_breaks(texts: pa.Array, number: str = "<num>", line_break: str = "\n\n") -> Edits:
    """Edits that replace every word with a digit 0-9 and every line break; found on the bytes of all texts at once."""
    data, bounds = text_bytes(texts)
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, []
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    inside = ~BLANK_BYTES[data]
    heads = np.r_[True, ~inside[:-1]]
    heads[bounds[bounds < len(data)]] = True
    heads = np.flatnonzero(heads & inside)
    tails = np.r_[~inside[1:], True]
    tails[bounds[bounds > 0] - 1] = True
    tails = np.flatnonzero(tails & inside) + 1
    digits = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
    numbers = digits[tails] > digits[heads]
    breaks = np.flatnonzero(data == 10)
    start, stop = np.r_[heads[numbers], breaks], np.r_[tails[numbers], breaks + 1]
    order = np.argsort(start, kind="stable")
    docs = np.searchsorted(bounds, start[order], side="right") - 1
    base = points[bounds[docs]]
    new = [line_break if k else number for k in (order >= int(numbers.sum())).tolist()]
    return docs, points[start[order]] - base, points[stop[order]] - base, new


def edited(text: str, edits: list[tuple[int, int, str]], offset: int = 0) -> str:
    out, at = [], 0
    for start, stop, new in edits:
        out += [text[at : start - offset], new]
        at = stop - offset
    return "".join([*out, text[at:]])


def apply_edits(trees: DataFrame, tokenizer: str, find: Callable[[pa.Array], Edits] | None = None) -> DataFrame:
    """doc_id and OUTPUT for every row of a table of trees.

    The edits are those of its column (see `edit_counts`), or what `find` gives for a batch of texts: document, start
    and stop in code points, and replacement, by document and start and without overlap.
    """
    edits = [] if find else [F.col("edits").cast(EDITS).alias("edits")]
    rows = trees.select("doc_id", "text", *edits, "sizes", "tree")

    def renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in joined(batches, "text"):
            sizes, bounds = _unpacked(batch.column("sizes"))
            first, last = bounds[:-1], bounds[1:] - 1
            ends = np.cumsum(sizes)  # of segments, in code points of the whole batch
            base = np.r_[0, ends][first]
            forest = Forest(np.diff(bounds))
            forest.nodes[:] = _unpacked(batch.column("tree"))[0]
            before = forest.roots
            texts = batch.column("text")
            docs, start, stop, new = find(texts) if find else listed_edits(batch.column("edits"), texts, ends[last] - base)
            i = np.searchsorted(ends, base[docs] + np.maximum(start - 1, 0), side="right")
            j = np.searchsorted(ends, base[docs] + stop, side="right")
            i = np.maximum(np.clip(i, first[docs], last[docs]) - 1, first[docs])
            j = np.minimum(np.clip(j, first[docs], last[docs]) + 1, last[docs])
            reach = np.maximum.accumulate(j) if len(j) else j
            opens = np.flatnonzero(np.r_[True, i[1:] > reach[:-1]]) if len(i) else i  # stretches that touch are one
            closes = np.r_[opens[1:], len(docs)].astype(np.int64)
            low, high, owner = i[opens], reach[closes - 1], docs[opens]
            redo: list[str] = []
            from_, to = np.r_[0, ends][low] - base[owner], ends[high] - base[owner]
            items = list(zip(start.tolist(), stop.tolist(), new, strict=True))
            held, text = -1, ""
            for doc, a, b, x, y in zip(*(v.tolist() for v in (owner, from_, to, opens, closes)), strict=True):
                if doc != held:
                    held, text = doc, texts[doc].as_py()
                redo.append(edited(text[a:b], items[x:y], a))
            pieces, _, counts = encoder.counts(pa.array(redo, pa.large_string()))
            totals = np.diff(np.r_[0, np.cumsum(counts)][pieces])
            widths = high - low + 1
            heads = np.cumsum(widths) - widths
            values = np.zeros(int(widths.sum()), dtype=np.int64)
            values[heads] = totals
            leaf = np.arange(len(values)) + np.repeat(low - heads, widths)
            of = np.repeat(owner, widths)
            forest.update(of, leaf - first[of], values)
            n = len(batch)
            again = np.bincount(owner, widths, minlength=n).astype(np.int64)
            columns = [before, forest.roots, np.bincount(docs, minlength=n), np.diff(bounds), again]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", *OUTPUT])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(renew, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in OUTPUT))


def edit_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """doc_id, n_tokens_before, n_tokens, n_edits, n_segments, n_encoded_again for every row.

    Edits are an array of (start, stop, text) over the code points of the old text; they are taken by start and
    cut to the text, and one that overlaps an earlier one is left out.  Null text is empty, null edits are none, a
    null replacement is empty.  Rows are independent of each other, also where ids repeat or are null; an empty table
    gives no rows.  Other columns are not read.  The trees are written down before the edits are applied.
    """
    trees = build_trees(docs, tokenizer, id_col, text_col, edits_col)
    return apply_edits(Workspace(docs.sparkSession).materialize(trees, "token-trees"), tokenizer)
