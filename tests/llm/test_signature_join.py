"""The signature-tree join against all pairs."""

import random

import pytest
from contracts import jaccard_components

from millrace.llm import masses, signature_join
from millrace.llm.common import prepare
from millrace.llm.signature_join import similar_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies(seed, groups, size, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=25)
    rows, ident = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(2, words)) + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((ident, " ".join(copy).title() if rng.random() < 0.1 else " ".join(copy)))
            ident += 1
    return rows


def run(spark, rows, n, percent):
    prepare(spark)
    df = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], SCHEMA).repartition(3)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(df, n, percent).collect()}


@pytest.mark.parametrize("n,percent,tile", [(4, 85, 1024), (5, 80, 3), (1, 60, 8)])
def test_like_all_pairs(spark, monkeypatch, n, percent, tile):
    monkeypatch.setattr(masses, "TILE", tile)
    rows = near_copies(n, 25, 12)
    assert run(spark, rows, n, percent) == jaccard_components(rows, n, percent)


def test_a_full_filter_of_routes_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(signature_join, "FILTER_BITS", 1 << 10)
    rows = near_copies(11, 25, 12)
    assert run(spark, rows, 4, 85) == jaccard_components(rows, 4, 85)


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "One two three"), (8, "é É"), (9, "É é")]
    want = {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (1, 9)}
    assert run(spark, rows, 4, 85) == want
    prepare(spark)
    assert similar_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_id_with_two_texts(spark):
    # Row 5 repeats: one text equals that of 3, the other is a near copy of that of 7.
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    near = y.replace("y39", "other")
    rows = [(3, x), (5, x), (5, y), (7, near), (9, " ".join(f"z{i}" for i in range(40)))]
    assert {i: c for i, (_, c) in run(spark, rows, 4, 85).items()} == {3: 3, 5: 3, 7: 3, 9: 9}


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    assert run(spark, rows, 4, 85) == jaccard_components(rows, 4, 85)
