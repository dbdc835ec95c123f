"""Token ids of whole texts: pieces between safe cuts, each distinct piece encoded once in a while.

A byte-level pre-tokenizer always cuts before a space whose neighbours are no white space, around a line
break whose neighbours are none, and before a full stop or comma between a letter or digit and such a space, break
or end.  So a text is the sequence of its pieces between these cuts (white space of any other kind stays inside a
piece), and the tokens of a piece depend on the piece alone.  Pieces are found, hashed and looked up in
numpy, a chunk of texts that the processor's own caches hold at a time; the cache is an open table of 64-bit hashes with
the ids of all pieces in one pool and their bytes in another.  A hit counts only if the bytes are the same; a piece whose hash
belongs to another piece is encoded by itself.  New pieces that begin with a space and have no other white space go
to the library as one text, whose ids are dealt out by the bytes that they stand for.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import BASE, mix, span_hashes

SLOTS = 1 << 21  # of the cache; about 70 MB; when half full, only pieces that were met again stay
HELD_BYTES = 1 << 25  # of the cached pieces
BATCH_BYTES = 5 << 20
CHUNK_BYTES = 1 << 19
_ENCODERS: dict[str, Encoder] = {}

_WHITE, _ALNUM, _LEAD, _MARK = np.zeros((4, 256), dtype=bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of all white space beyond ASCII
_MARK[[ord("."), ord(",")]] = True
_CLEAN = re.compile(r" ?\S+")
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)  # the first n bytes of eight


def flat_lists(lists: list[np.ndarray], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All items in one array, and where each list begins (one more than lists)."""
    bounds = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    return (np.concatenate(lists) if lists else np.zeros(0)).astype(dtype, copy=False), bounds


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of every pair, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


def joined(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about BATCH_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Texts in runs of about `size` bytes."""
    rows = max(1, int(len(texts) * size / max(1, texts.nbytes)))
    for i in range(0, max(1, len(texts)), rows):
        yield texts.slice(i, rows)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; 16 bytes behind `data` count as 0."""
    padded = np.zeros(len(data) + 24, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 17,), dtype="<u8", buffer=padded, strides=(1,))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts and where each text begins (one more than texts); null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, raw = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw else np.zeros(0, dtype=np.uint8)
    return data, bounds - bounds[0]


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions where pieces begin."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    cuts = np.flatnonzero((data == 32) | (data == 10) | _MARK[data])
    before, after = data[np.maximum(cuts - 1, 0)], data[np.minimum(cuts + 1, n - 1)]
    at_head, at_end = first[cuts], first[cuts + 1]
    # White space before a cut: an ASCII one, or the last byte of another one.
    wide = (data[np.maximum(cuts - 2, 0)] == 0xC2) | _LEAD[data[np.maximum(cuts - 3, 0)]]
    blank_before = _WHITE[before] | ((before >= 0x80) & wide)
    blank_after = _WHITE[after] | _LEAD[after]
    alone = ~at_head & ~at_end & ~blank_before & ~blank_after
    space, line, mark = data[cuts] == 32, data[cuts] == 10, _MARK[data[cuts]]
    starts = first[:-1].copy()
    starts[cuts[space & alone]] = True
    starts[cuts[line & alone]] = True
    starts[cuts[line & alone] + 1] = True
    # A mark between a letter or digit and a cut or end.
    cut_next = at_end | starts[np.minimum(cuts + 1, n - 1)] & ((after == 32) | (after == 10))
    starts[cuts[mark & ~at_head & _ALNUM[before] & cut_next]] = True
    return np.flatnonzero(starts)


def piece_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces, never 0; those of up to 16 bytes are read as two numbers."""
    sizes = np.diff(np.r_[starts, len(data)])
    words = eights(data)
    out = mix((words[starts] & _LOW[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * np.uint64(BASE)))
    more = np.flatnonzero(sizes > 8)
    out[more] = mix(out[more] + (words[starts[more] + 8] & _LOW[np.minimum(sizes[more] - 8, 8)]))
    long = np.flatnonzero(sizes > 16)
    if len(long):
        out[long] = span_hashes(data, starts[long], sizes[long])
    return np.maximum(out, np.uint64(1))


class Encoder:
    """A tokenizer of the tokenizers library behind a cache of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._newline = newline[0] if len(newline) == 1 else None
        # Bytes that each id stands for: a byte-level vocabulary has a character for each.
        self._bytes_of = np.zeros(self.vocabulary, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if i < self.vocabulary:
                self._bytes_of[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            if i < self.vocabulary:
                self._bytes_of[i] = len(token.content.encode())
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(SLOTS, dtype=np.uint64)
        self._at = np.zeros(SLOTS, dtype=np.int64)
        self._length = np.zeros(SLOTS, dtype=np.int32)
        self._pool = np.zeros(1 << 20, dtype=self.dtype)
        self._spot = np.zeros(SLOTS, dtype=np.int64)
        self._size = np.zeros(SLOTS, dtype=np.int32)
        self._again = np.zeros(SLOTS, dtype=bool)
        self._bytes = np.zeros(1 << 20, dtype=np.uint8)
        self._used = self._entries = self._held = 0

    def _renew(self) -> None:
        """Empties the cache but for the pieces that were met again since it was last emptied, if they leave room."""
        kept = np.flatnonzero(self._again)
        sizes, counts = self._size[kept].astype(np.int64), self._length[kept].astype(np.int64)
        room = len(kept) <= SLOTS // 4 and sizes.sum() <= HELD_BYTES // 2
        held = self._keys[kept], gather(self._bytes, self._spot[kept], sizes), sizes, gather(self._pool, self._at[kept], counts), counts
        self._clear()
        if room:
            self._insert(*held)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per process and file."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype) for e in coded]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the count of each piece.  Pieces without white space inside go as the lines of one text."""
        lines = [i for i, p in enumerate(pieces) if _CLEAN.fullmatch(p)] if self._newline is not None else []
        parts: list[np.ndarray | None] = [None] * len(pieces)
        if lines:
            (coded,) = self.tokenizer.encode_batch_fast(["\n".join([pieces[i] for i in lines])], add_special_tokens=False)
            ids = np.array(coded.ids, dtype=self.dtype)
            cuts = np.flatnonzero(ids == self._newline)
            if len(cuts) != len(lines) - 1:
                lines = []
            elif len(lines) == len(pieces):
                return np.delete(ids, cuts), np.diff(np.r_[-1, cuts, len(ids)]) - 1
            else:
                for i, s, e in zip(lines, np.r_[0, cuts + 1].tolist(), np.r_[cuts, len(ids)].tolist(), strict=True):
                    parts[i] = ids[s:e]
        rest = [i for i, p in enumerate(parts) if p is None]
        for i, ids in zip(rest, self._encode([pieces[i] for i in rest]), strict=True):
            parts[i] = ids
        flat, bounds = flat_lists(parts, self.dtype)
        return flat, np.diff(bounds)

    def _encode_spans(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the count of each of the pieces that lie one after the other in `raw`."""
        ends = np.cumsum(sizes)
        starts = ends - sizes
        white = np.add.reduceat((_WHITE[raw] | _LEAD[raw]).astype(np.int64), starts) if len(starts) else starts
        led = (raw[starts] == 32) & (white == 1) & (sizes > 1)
        one, rest = np.flatnonzero(led), np.flatnonzero(~led)
        ids, counts = np.zeros(0, dtype=self.dtype), np.zeros(len(sizes), dtype=np.int64)
        if len(one):
            text = gather(raw, starts[one], sizes[one]).tobytes().decode()
            (coded,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(coded.ids, dtype=self.dtype)
            own, reached = np.cumsum(sizes[one]), np.cumsum(self._bytes_of[ids])
            last = np.searchsorted(reached, own)
            if len(reached) and reached[-1] == own[-1] and np.array_equal(reached[last], own):
                counts[one] = np.diff(np.r_[-1, last])
            else:  # the vocabulary is not one of bytes
                ids, one, rest = ids[:0], one[:0], np.arange(len(sizes))
        if len(rest) == 0:
            return ids, counts
        other, counts[rest] = self._encode_pieces([raw[s:e].tobytes().decode() for s, e in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
        both, at = np.r_[one, rest], np.empty(len(sizes), dtype=np.int64)
        at[both] = np.cumsum(counts[both]) - counts[both]
        return gather(np.concatenate([ids, other]), at, counts), counts

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        held = self._keys[slot]
        out = np.where(held == hashes, slot, -1)
        open_ = np.flatnonzero((held != hashes) & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
            held = self._keys[slot[open_]]
            same = held == hashes[open_]
            out[open_[same]] = slot[open_[same]]
            open_ = open_[~same & (held != 0)]
        return out

    def _append(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Puts ids into the pool; where each piece's ids begin."""
        if self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool[: self._used], np.zeros(self._used + 2 * len(ids), dtype=self.dtype)])
        self._pool[self._used : self._used + len(ids)] = ids
        at = self._used + np.cumsum(counts) - counts
        self._used += len(ids)
        return at

    def _insert(self, hashes: np.ndarray, raw: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct new hashes with their pieces, one after the other in `raw`, and ids."""
        at = self._append(ids, counts)
        if self._held + len(raw) + 24 > len(self._bytes):
            self._bytes = np.concatenate([self._bytes[: self._held], np.zeros(self._held + 2 * len(raw) + 24, dtype=np.uint8)])
        self._bytes[self._held : self._held + len(raw)] = raw
        spots = self._held + np.cumsum(sizes) - sizes
        self._held += len(raw)
        self._entries += len(hashes)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            free = self._keys[slot[open_]] == 0
            self._keys[slot[open_[free]]] = hashes[open_[free]]
            won = self._keys[slot[open_]] == hashes[open_]
            done = open_[won]
            self._at[slot[done]], self._length[slot[done]] = at[done], counts[done]
            self._spot[slot[done]], self._size[slot[done]] = spots[done], sizes[done]
            open_ = open_[~won]
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)

    def pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids are in the pool, and how many."""
        hashes = piece_hashes(data, starts)
        slots = self._slots(hashes)
        lost = np.flatnonzero(slots < 0)
        self._again[slots[slots >= 0]] = True
        sizes = np.diff(np.r_[starts, len(data)])
        if len(lost):
            if self._entries + len(lost) > SLOTS // 2 or self._held > HELD_BYTES:
                self._renew()
                slots = self._slots(hashes)
                lost = np.flatnonzero(slots < 0)
            new, where = np.unique(hashes[lost], return_index=True)
            if self._entries + len(new) > SLOTS // 2:
                self._clear()
                lost = np.arange(len(hashes))
                new, where = np.unique(hashes, return_index=True)
            if len(new) > SLOTS // 2:  # more than the cache holds: encode this batch by halves
                half = len(starts) // 2
                return self._halves(data, starts, half)
            own = lost[where]
            raw = gather(data, starts[own], sizes[own])
            self._insert(new, raw, sizes[own], *self._encode_spans(raw, sizes[own]))
            slots[lost] = self._slots(hashes[lost])
        at, length = self._at[slots], self._length[slots].astype(np.int64)
        other = self._strangers(data, starts, sizes, slots)
        if len(other):
            ids, counts = self._encode_spans(gather(data, starts[other], sizes[other]), sizes[other])
            at[other], length[other] = self._append(ids, counts), counts
        return at, length

    def _strangers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Pieces that differ from the piece that holds their slot."""
        differ = self._size[slots] != sizes
        spots, words = self._spot[slots], eights(data)
        held = np.ndarray((len(self._bytes) - 7,), dtype="<u8", buffer=self._bytes, strides=(1,))
        differ |= ((words[starts] ^ held[spots]) & _LOW[np.minimum(sizes, 8)]) != 0
        more = np.flatnonzero(sizes > 8)
        differ[more] |= ((words[starts[more] + 8] ^ held[np.minimum(spots[more] + 8, len(held) - 1)]) & _LOW[np.minimum(sizes[more] - 8, 8)]) != 0
        same = np.flatnonzero(~differ & (sizes > 16))
        ends, i = np.cumsum(sizes[same]), 0
        while i < len(same):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_BYTES, side="right")))
            own = same[i:j]
            ours, held = gather(data, starts[own], sizes[own]), gather(self._bytes, spots[own], sizes[own])
            if not np.array_equal(ours, held):
                wrong = np.flatnonzero(ours != held)
                first = ends[i - 1] if i else 0
                differ[own[np.unique(np.searchsorted(ends[i:j] - first, wrong, side="right"))]] = True
            i = j
        return np.flatnonzero(differ)

    def _halves(self, data: np.ndarray, starts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Two passes whose ids are copied out of the cache into a pool of their own."""
        cut = int(starts[half])
        parts = []
        for own, begin in ((data[:cut], starts[:half]), (data[cut:], starts[half:] - cut)):
            at, counts = self.pieces(own, begin)
            parts.append((gather(self._pool, at, counts), counts))
        self._clear()
        self._pool = np.concatenate([p for p, _ in parts])
        self._used = len(self._pool)
        counts = np.concatenate([c for _, c in parts])
        return np.cumsum(counts) - counts, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and where each text's ids begin; null counts as empty."""
        parts = [self._encode_chunk(part) for part in slices(texts, CHUNK_BYTES)]
        before = np.cumsum([0, *[len(ids) for ids, _ in parts]])
        bounds = [b[:-1] + n for (_, b), n in zip(parts, before, strict=False)]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([*bounds, before[-1:]])

    def _encode_chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = text_bytes(texts)
        starts = piece_starts(data, bounds)
        at, counts = self.pieces(data, starts)
        ends = np.r_[0, np.cumsum(counts)]
        return gather(self._pool, at, counts), ends[np.searchsorted(starts, bounds)]

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's pieces begin (one more than texts), each piece's code points, each piece's ids."""
        data, bounds = text_bytes(texts)
        starts = piece_starts(data, bounds)
        _, counts = self.pieces(data, starts)
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        return np.searchsorted(starts, bounds), np.diff(points[np.r_[starts, len(data)]]), counts
