"""Spelling variants: words of a corpus that lie one letter apart, and the form each of them stands for.

1. Words are counted document by document in each task; the partial counts are summed.
2. Of two words one letter apart, with c letters in the shorter one, either the first c // 2 letters are the same
   or the last c - c // 2 are.  So words meet in blocks of equal (c, side, letters); every pair comes up in one block.
   Blocks of more than TILE words are met by TILE asking words a task.
3. A block has a bit-sliced position index: for each (position, letter) the set of its words that have the
   letter there, as one long integer.  For an asking word, the words that agree so far (no error), those with one replaced letter
   and those with one letter more (same sets, positions shifted by one) are carried along its letters by AND and OR
   over all words of the block at once.
4. A word's form is its near word of largest count where that is large enough; roots follow forms by pointer
   doubling, every step written down.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .common import col

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS = 6
LEAST_COUNT = 5
FACTOR = 5
TILE = 4096
HELD_LETTERS = 1 << 22  # of the words counted by a task before it hands its counts on


def word_counts(docs: DataFrame, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the words of LEAST_LETTERS letters or more; words are runs of letters, A-Z in lower case.

    With damage given, a run loses its letter h % length where damage divides h, the crc32 of "id:run" (a null id
    is an empty one).
    """
    rows = docs.select(col(id_col).cast("string").alias("id"), col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = defaultdict(int)
        held = 0

        def close() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], ["word", "n"])
            sums.clear()
            return batch

        for batch in batches:
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                found = Counter(RUN.findall((text.as_py() or b"").lower().decode()))
                start = zlib.crc32(f"{name or ''}:".encode())
                for word, n in found.items():
                    if len(word) < LEAST_LETTERS:
                        continue
                    if damage:
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LETTERS:
                                continue
                    if word not in sums:
                        held += len(word)
                    sums[word] += n
                if held > HELD_LETTERS:
                    yield close()
                    held = 0
        if sums:
            yield close()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bits(places: list[int], size: int) -> int:
    if size <= 256:
        return sum(1 << i for i in places)
    flags = np.zeros(size, dtype=np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def near_in_block(words: list[str], asking: list[int], shorter: int, same: int) -> Iterator[tuple[int, int]]:
    """Pairs of places: an asking word of `shorter` letters and a word one replaced or one more letter away.

    All words have `shorter` letters or one more and agree in the first `same`.
    """
    size = len(words)
    places: dict[tuple[int, str], list[int]] = defaultdict(list)
    for i, word in enumerate(words):
        for j in range(same, len(word)):
            places[j, word[j]].append(i)
    index = {key: _bits(held, size) for key, held in places.items()}
    longer = _bits([i for i, w in enumerate(words) if len(w) > shorter], size)
    every = (1 << size) - 1
    for i in asking:
        word, exact, replaced, inserted = words[i], every, 0, 0
        for j in range(same, shorter):
            here, next_ = index[j, word[j]], index.get((j + 1, word[j]), 0)
            inserted = (inserted | exact) & next_
            replaced = (replaced & here) | (exact & ~here)
            exact &= here
        for k in _members((replaced & ~longer) | ((inserted | exact) & longer)):
            yield i, k


def near_pairs(vocabulary: DataFrame, space: Workspace) -> DataFrame:
    """word, near, near_n for all ordered pairs of words (of vocabulary: word, n) that are one letter apart."""
    size = F.char_length("word")
    sides = []
    for c in (size, size - 1):
        head, tail = F.floor(c / 2).cast("int"), (c - F.floor(c / 2)).cast("int")
        for side, letters, same in ((0, F.substring("word", F.lit(1), head), head), (1, F.right("word", tail), tail)):
            sides.append(F.struct(c.alias("c"), F.lit(side).alias("side"), letters.alias("letters"), same.alias("same")))
    keyed = vocabulary.select("word", "n", F.explode(F.array(*sides)).alias("key")).select("word", "n", "key.*")
    keyed = keyed.filter("c > 0")
    large = keyed.groupBy("c", "side", "letters").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") > TILE)
    large = space.materialize(large, "large-blocks")
    tiles = F.coalesce(F.ceil(F.col("words") / TILE), F.lit(1)).cast("int")
    dealt = keyed.join(large, ["c", "side", "letters"], "left").withColumn("own", F.pmod(F.xxhash64("word"), tiles))
    dealt = dealt.withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
    asks = (F.col("own") == F.col("tile")) & (F.char_length("word") == F.col("c"))
    keys = ["c", "side", "letters", "tile"]
    sent = dealt.select(*keys, "same", "word", "n", asks.alias("asks")).repartition(*keys).sortWithinPartitions(*keys)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        def batch_of(found: list[tuple[str, str, int]]) -> pa.RecordBatch:
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["word", "near", "near_n"])

        found: list[tuple[str, str, int]] = []
        for (c, side, _, _), group in groupby(rows(), key=lambda r: r[:4]):
            block = list(group)
            asking = [i for i, r in enumerate(block) if r[7]]
            if len(block) == 1 or not asking:
                continue
            words = [r[5][::-1] if side else r[5] for r in block]
            for i, k in near_in_block(words, asking, c, block[0][4]):
                (_, _, _, _, _, a, n, _), (_, _, _, _, _, b, m, _) = block[i], block[k]
                if len(b) == c:  # the other word asks as well
                    found.append((a, b, m))
                elif not side or a[: c // 2] != b[: c // 2]:
                    found += [(a, b, m), (b, a, n)]
            if len(found) > 10_000:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    return sent.mapInArrow(meet, "word string, near string, near_n long")


def spelling_variants(
    docs: DataFrame, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of LEAST_LETTERS letters and LEAST_COUNT occurrences or more.

    Near words differ by exactly one inserted, deleted or replaced code point.  form is the near word of largest
    count (ties: the smallest in code-point order) where that count is at least FACTOR times the word's own, else
    null; root is the last word reached by following forms.  Null and empty texts have no words; rows count each for
    itself, whatever their id; an empty table gives no rows; other columns are not read.
    """
    space = Workspace(docs.sparkSession)
    counts = word_counts(docs, damage, id_col, text_col).filter(F.col("n") >= LEAST_COUNT)
    vocabulary = space.materialize(counts, "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = near_pairs(vocabulary, space).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    chosen = vocabulary.join(near, "word", "left").withColumn("form_n", -F.col("best.m"))
    strong = F.col("form_n") >= FACTOR * F.col("n")
    chosen = chosen.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n"),
    )
    chosen = space.materialize(chosen, "forms")
    roots = space.materialize(chosen.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # forms at least quintuple the count, so no circle and few rounds
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = roots.join(further, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
        )
        roots = space.materialize(moved, "roots")
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    found = chosen.join(roots.select("word", "root"), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
