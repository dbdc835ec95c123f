"""The b-bit MinHash join against all pairs."""

import random

import numpy as np
import pytest
from contracts import jaccard_components
from test_signature_join import SCHEMA, near_copies

from millrace.llm import masses, minhash
from millrace.llm.common import prepare
from millrace.llm.queries import minhash_dedup
from millrace.llm.shingles import mix
from millrace.llm.signature_join import similar_components


def run(spark, rows, n, percent):
    prepare(spark)
    df = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], SCHEMA).repartition(3)
    found = minhash.near_copies(df, n, percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}


@pytest.mark.parametrize("n,percent,tile", [(3, 85, 512), (5, 80, 3), (1, 60, 8), (2, 100, 512)])
def test_like_all_pairs(spark, monkeypatch, n, percent, tile):
    monkeypatch.setattr(masses, "TILE", tile)
    rows = near_copies(n + 10, 25, 12)
    assert run(spark, rows, n, percent) == jaccard_components(rows, n, percent)


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.85):
        common = int(2000 * share)
        flat = mix(rng.integers(1, 1 << 62, 4000 - common).astype(np.uint64))
        one, two = flat[:2000], flat[2000 - common :]
        signs = minhash.signatures(minhash.minima(np.concatenate([one, two]), np.array([0, 2000])))
        real = common / (4000 - common)
        assert abs(minhash.estimate(minhash.matches(signs[:1], signs[1:])[0]) - real) < 0.15


def test_layout_and_bounds():
    assert minhash.band_layout(85) == (32, 5)
    bands, rows = minhash.band_layout(60)
    assert rows < 5 and (1 - 0.6**rows) ** bands <= minhash.LOSS
    assert minhash.band_layout(100) == (1, 5) and minhash.least_matches(100) == minhash.HASHES
    assert 0.6 < minhash.estimate(minhash.least_matches(85)) < 0.75
    with pytest.raises(ValueError):
        minhash.band_layout(2)


def test_spanning_forest_and_tiles():
    rng = np.random.default_rng(5)
    p, q = rng.integers(0, 60, 80), rng.integers(0, 60, 80)
    keep, least = masses.spanning(p, q, 60)

    def labels(pairs):
        label = list(range(60))
        for a, b in pairs:
            a, b = label[a], label[b]
            label = [min(a, b) if x in (a, b) else x for x in label]
        return label

    assert least.tolist() == labels(zip(p[keep], q[keep], strict=True)) == labels(zip(p, q, strict=True))
    assert len(keep) == 60 - len(set(labels(zip(p, q, strict=True))))
    sets = [np.unique(rng.integers(0, 30, 20)).astype(np.uint64) for _ in range(40)]
    want = [(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))]
    assert list(zip(*[x.tolist() for x in masses.linked_pairs(sets, 50)], strict=True)) == want


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One two"), (8, "é É x y"), (9, "É é x y"), (None, "one two")]
    want = {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (2, 8), 9: (2, 9), None: (1, None)}
    assert run(spark, rows, 3, 85) == want
    prepare(spark)
    assert minhash.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_and_long_texts(spark):
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    long = " ".join(f"z{i}" for i in range(150_000))
    rows = [(3, x), (5, x), (5, y), (7, y.replace("y39", "other")), (9, long), (10, long.replace("z77 ", "other "))]
    assert {i: c for i, (_, c) in run(spark, rows, 3, 85).items()} == {3: 3, 5: 3, 7: 3, 9: 9, 10: 9}


def all_pairs(texts, percent):
    """Smallest member of each text's component, over all pairs."""
    sets = [set(zip(w, w[1:], w[2:], strict=False)) for w in (t.split() for t in texts)]
    least = list(range(len(sets)))
    for i, s in enumerate(sets):
        for j in range(i):
            common = len(s & sets[j])
            if least[i] != least[j] and 100 * common >= percent * (len(s) + len(sets[j]) - common):
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = [new if x == old else x for x in least]
    return least


@pytest.mark.parametrize("operator", [minhash.near_copies, similar_components])
def test_mass_of_near_copies(spark, operator):
    """Near copies of a text that is not the smallest id, at many similarities, in more than one block."""
    prepare(spark)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(1200):
        copy = list(base)
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in operator(df, 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == all_pairs(texts, 85)


def test_query_like_its_contract(spark):
    source = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{source}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup(spark, source).collect()}
    assert got == jaccard_components(rows, 3, 85)
