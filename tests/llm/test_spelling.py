"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from contracts import LOWER

from millrace.llm import spelling
from millrace.llm.common import prepare
from millrace.llm.queries import variant_spellings
from millrace.llm.spelling import spelling_variants

SCHEMA = "doc_id long, text string, word string, n long"


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            for c in letters:
                yield word[:i] + c + word[i + 1 :]


def brute(rows, damage):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    letters = sorted({c for w in counts for c in w})
    near = {w: {x for x in edits(w, letters) if x in counts and x != w} for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def as_dict(df):
    rows = df.collect()
    found = {r.word: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("tile,damage", [(4096, None), (3, 7)])
def test_like_all_pairs(spark, monkeypatch, tile, damage):
    prepare(spark)
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = random.Random(tile)
    words = ["".join(rng.choices("abé", k=rng.randint(5, 9))) for _ in range(150)]
    words += [w[:i] + rng.choice("abcÀ") + w[i:] for w in words for i in [rng.randint(0, len(w))]]
    words += [w[:-1] for w in words if rng.random() < 0.3] + ["x" * 40, "x" * 41, "x" * 20 + "y" + "x" * 20]
    rows = []
    for i in range(300):
        chosen = rng.choices(words, weights=[1 + 300 // (k + 1) for k in range(len(words))], k=60)
        rows.append((i if i else None, ", ".join(w.upper() if rng.random() < 0.1 else w for w in chosen)))
    df = spark.createDataFrame([(*r, "word", 1) for r in rows], SCHEMA).repartition(3)
    want = brute(rows, damage)
    assert sum(1 for v in want.values() if v[0]) > 10
    assert as_dict(spelling_variants(df, damage)) == want


def test_edges_of_the_input(spark):
    prepare(spark)
    rows = [(1, None), (2, ""), (3, "letter " * 5), (3, "LETTER lettér " * 5), (4, "short " * 9), (5, "fourfold " * 4), (6, "a" * 100_000 + " ")]
    rows += [(6, "a" * 100_000)] * 4
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = as_dict(spelling_variants(df))
    assert got == {"letter": (None, "letter", 10, 1, None), "lettér": (None, "lettér", 5, 1, None), "a" * 100_000: (None, "a" * 100_000, 5, 0, None)}
    assert spelling_variants(df.limit(0)).count() == 0


def test_query_like_its_contract(spark):
    source = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{source}/documents.parquet").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in rows], 199)
    got = as_dict(variant_spellings(spark, source))
    assert got == want and len(got) > 100
