"""Word shingles of whole texts as sorted arrays of 64-bit hashes, in numpy over Arrow buffers.

A-Z is lower-cased, words are runs of bytes other than blanks (0x09-0x0D and 0x20, which occur in
UTF-8 as themselves only).  A word's hash is the sum of one random number for each byte at its place
(tabulation; words of more than PLACES bytes go through BLAKE2b); a shingle's hash
combines the hashes of its words.  Bytes are taken in blocks that end between words, so memory stays
small however long a text is: only 8 bytes a word are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
PLACES = 256

BLANK_BYTES = np.zeros(256, dtype=bool)
BLANK_BYTES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(BASE)))


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start : start + length]; no span is empty."""
    out = np.zeros(len(starts), dtype=np.uint64)
    ends = np.cumsum(lengths)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, side="right")))
        own, first = lengths[i:j], starts[i:j]
        short = np.flatnonzero(own <= PLACES)
        own, first = own[short].astype(np.int32), first[short]
        if len(own):
            at = np.cumsum(own, dtype=np.int32) - own
            place = np.arange(at[-1] + own[-1], dtype=np.int32) - np.repeat(at, own)
            spots = place + np.repeat((first - first[0]).astype(np.int32), own)
            values = _TABLE[(place << 8) | data[first[0] :][spots]]
            out[i + short] = mix(np.add.reduceat(values, at) + own.astype(np.uint64))
        i = j
    for k in np.flatnonzero(lengths > PLACES).tolist():
        span = data[starts[k] : starts[k] + lengths[k]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little")
    return out


def _block_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word; a word also ends where a text does (cuts)."""
    inside = ~BLANK_BYTES[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[cuts[cuts < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts[(cuts > 0) & (cuts <= len(data))] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return span_hashes(_LOWER[data], starts, ends - starts), starts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more than texts)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, raw = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):  # go on to the next blank or end of text
            step = BLANK_BYTES[data[end : end + 4096]]
            stop = end + (int(step.argmax()) if step.any() else len(step))
            cut = int(bounds[np.searchsorted(bounds, end)])
            if cut <= stop:
                end = cut
                break
            end = stop
            if step.any():
                break
        inner = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, end, side="right")] - at
        h, s = _block_hashes(data[at:end], inner)
        hashes.append(h)
        starts.append(s + at)
        at = end
    all_starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(all_starts, bounds)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles.

    Fewer words than n make one shingle of the whole sequence; no words make an empty set.
    """
    hashes, bounds = word_hashes(texts)
    salts = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)

    def combined(part: np.ndarray, width: int) -> np.ndarray:
        total = np.zeros(len(part) - width + 1, dtype=np.uint64)
        for k in range(width):
            total += part[k : len(part) - width + 1 + k] * salts[k]
        return mix(total + np.uint64(width))

    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        words = hashes[start:end]
        yield np.unique(combined(words, min(n, len(words)))) if len(words) else words
