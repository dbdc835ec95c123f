"""Periodic runs of words: maximal stretches that repeat a period of q words at least twice.

A suffix automaton of the words is built, and its tree of suffix links is held as a link-cut forest.  The
words are then appended one by one: access to the state of prefix i walks the path of all suffixes that end
at i, which falls into segments of equal last end e.  A segment whose longest suffix has L words gives a square
where i - e <= L: both ends carry the same L words, so the stretch from i - (i - e) - L + 1 to i has period i - e, and
that stretch reaches as far left as the period does.  The path then gets the colour i, which amounts to O(log n)
segments a word.  Going on to later ends of the same start and period extends squares to runs; periods found this
way are always the smallest ones of their stretch (a shorter period would mean a later last end).

Before that, what cannot lie in a run is set aside without loss: in a run of at least `least` words
each word lies in a window of ceil(least / 2) words that occurs again within the run.  So the text is cut to
stretches covered by windows that repeat inside their own stretch, until nothing changes; windows are
compared by hash, where a collision only keeps more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col
from .shingles import mix

LEAST = 12
RUNS = "array<struct<start:long,length:long,period:long>>"


def suffix_automaton(items: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and greatest length of each state, and the state of each prefix.  State 1 is the empty one, 0 none."""
    step: list[dict[int, int]] = [{}, {}]
    link, length, prefix = [0, 0], [0, 0], []
    last = 1
    for item in items:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(1)
        at = last
        while at and item not in step[at]:
            step[at][item] = now
            at = link[at]
        if at:
            old = step[at][item]
            if length[old] == length[at] + 1:
                link[now] = old
            else:
                twin = len(step)
                step.append(step[old].copy())
                length.append(length[at] + 1)
                link.append(link[old])
                link[old] = link[now] = twin
                while at and step[at].get(item) == old:
                    step[at][item] = twin
                    at = link[at]
        prefix.append(now)
        last = now
    return link, length, prefix


class LinkCut:
    """Root paths of a fixed tree as splay trees; the root of a splay tree holds the colour of its whole path."""

    def __init__(self, parents: list[int]):
        self.up = list(parents)
        self.left = [0] * len(parents)
        self.right = [0] * len(parents)
        self.colour = [-1] * len(parents)

    def _lift(self, x: int) -> bool:
        """Rotates x above its parent in its splay tree; False where it is the top."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if left[p] == x:
            c = left[p] = right[x]
            right[x] = p
        elif right[p] == x:
            c = right[p] = left[x]
            left[x] = p
        else:
            return False
        if c:
            up[c] = p
        g = up[x] = up[p]
        up[p] = x
        if left[g] == p and g:
            left[g] = x
        elif right[g] == p and g:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]
        return True

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                self._lift(p if (left[p] == x) == (left[g] == p) else x)
            self._lift(x)

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """(deepest node, colour) of each segment of the path from the root to the node, which takes the new colour."""
        found, below, x = [], 0, node
        while x:
            self._splay(x)
            found.append((x, self.colour[x]))
            cut = self.right[x]
            if cut:
                self.colour[cut] = self.colour[x]
            self.right[x] = below
            below, x = x, self.up[x]
        self.colour[below] = colour
        self._splay(node)
        return found


def runs_of(items: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with max(least, 2 * period) items or more, by start and period."""
    link, length, prefix = suffix_automaton(items)
    forest = LinkCut(link)
    ends: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefix):
        for node, last in forest.access(state, i):
            if last >= 0 and i - last <= length[node]:
                ends[last - length[node] + 1, i - last] = i
    found = ((start, end - start + 1, period) for (start, period), end in ends.items())
    return sorted((s, n, q) for s, n, q in found if n >= max(least, 2 * q))


def covered(items: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, stop) of the stretches that can hold runs."""
    width = -(-least // 2)
    salts = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    if len(items) < least:
        return []
    windows = np.zeros(len(items) - width + 1, dtype=np.uint64)
    for k in range(width):
        windows += mix(items[k : len(windows) + k].astype(np.uint64) + salts[k])
    done, todo = [], [(0, len(items))]
    while todo:
        start, stop = todo.pop()
        own = windows[start : stop - width + 1]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        if not same.any():
            continue
        edges = np.zeros(stop - start + 1, dtype=np.int64)
        again = np.zeros(len(own), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        at = np.flatnonzero(again)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + width, -1)
        inside = np.r_[False, np.cumsum(edges) > 0]
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + start
        parts = [(a, b) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True) if b - a >= least]
        if parts == [(start, stop)]:
            done.append((start, stop))
        else:
            todo += parts
    return sorted(done)


def word_runs(words: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """Runs of one text, given as its words."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    items = [number.setdefault(w, len(number)) for w in words]
    if len(number) == len(words):
        return []
    found = []
    for start, stop in covered(np.array(items, dtype=np.int64), least):
        found += [(start + s, n, q) for s, n, q in runs_of(items[start:stop], least)]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    keep = np.cumsum(edges)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs, collapsed_text for every row.

    Words are runs of characters other than the blanks 0x20 and 0x09-0x0D.  runs holds (start, length, period) in
    words from 0, by start and period.  collapsed_text holds the words that no run contains after its first period,
    joined by one space.  Null and empty texts have no words, no runs and an empty collapsed text.  Rows stand for
    themselves, whatever their id is (null and repeated ids too); an empty table gives no rows; other columns are not
    read.  A text is one unit of work: memory is about 100 bytes a word, and 1 KB a word of what can hold runs.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, flat, sizes, texts = [], [], [0], []
            for text in batch.column("text").cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                runs = word_runs(words, least)
                counts.append(len(words))
                flat += runs
                sizes.append(len(flat))
                texts.append(b" ".join(collapsed(words, runs)))
            columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            items = pa.StructArray.from_arrays(columns, ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)
            text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), lists, text],
                ["doc_id", "n_words", "runs", "collapsed_text"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(find, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed_text string")
