"""Parallel resolution against the sequential pass, on random names full of near copies."""

import random

import pytest
from brute import normalize, ratio, sequential
from pyspark.sql import functions as F

from millrace.operators import resolve as rs
from millrace.operators import similarity as sim
from millrace.operators.similarity import _common_subsequence, _lost_grams, gram_size
from millrace.session import Workspace

WORDS = ["acme", "north", "star", "data", "robot", "vision", "labs", "inc", "über", "quantum", "deep", "grid"]


def random_names(rng, n):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            name = list(rng.choice([x for x in out if x] or ["acme"]))
            for _ in range(rng.randint(0, 2)):
                spot = rng.randrange(len(name) + 1)
                if rng.random() < 0.5 and name:
                    del name[min(spot, len(name) - 1)]
                else:
                    name.insert(spot, rng.choice("abcdeg .x"))
            text = "".join(name)
            if rng.random() < 0.3:
                parts = text.split()
                rng.shuffle(parts)
                text = " ".join(parts)
            out.append(text.upper() if rng.random() < 0.2 else text)
        elif rng.random() < 0.05:
            out.append(rng.choice([None, "", "  ", "Labs", "!!!", "Inc."]))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) + rng.choice(["", " Inc.", ", LLC", " 7"]))
    return out


def run(spark, names, seeds, threshold, limits=rs.ElectionLimits()):
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    table = spark.createDataFrame(
        [(i, c, a) for i, (c, a) in enumerate(seeds)], "position bigint, canonical string, alias string"
    )
    rows = rs.resolve(df, "name", "id", table, threshold, limits).orderBy("id").collect()
    return [(r.canonical_name, r.method, r.confidence) for r in rows]


SEEDS = [("Acme", "Acme"), ("Acme", "Acme Data"), ("North Star", "North Star"), ("North Star", "northstar.io"), ("Acme", "grid deep")]


@pytest.mark.parametrize(
    "seed,threshold,limits",
    [
        (1, 90.0, rs.ElectionLimits()),
        (2, 80.0, rs.ElectionLimits(parallel_rounds=0)),
        (3, 62.0, rs.ElectionLimits()),
        (4, 90.0, rs.ElectionLimits(first_slice=40, first_pairs_per_key=1, pairs_per_core=20, smallest_slice=10, checks_per_task=30, parallel_rounds=1)),
        (5, 75.0, rs.ElectionLimits(first_slice=30)),
    ],
)
def test_equals_sequential_pass(spark, seed, threshold, limits):
    names = random_names(random.Random(seed), 260)
    expected = sequential(names, SEEDS, threshold)
    assert len({m for _, m, _ in expected}) >= 4
    assert run(spark, names, SEEDS, threshold, limits) == expected


def test_later_leader_can_overtake(spark):
    # The third name first matches the first leader; once a closer one registers, it wins.
    names = ["abcdefghij0123456789", "abcdefghij01234567", "abcdefghij01234567xyzw", "abcdefghij01234567xy", "abcdefghij01234567"]
    assert run(spark, names, [("Zzz", "Zzz")], 90.0) == sequential(names, [("Zzz", "Zzz")], 90.0)


def test_variants_of_known_and_new_names(spark):
    seeds = [("Tern", "Tern"), ("Tern", "Tern, Inc."), ("Grey Mill", "Grey Mill"), ("Grey Mill", "Grey Mill Works")]
    names = ["TERN", "Tern, Inc.", "Tern Systems", "Saltmarsh Pump Makers LLC", "saltmarsh pump makers",
             "Saltmarsh Pump Maker", "Grey Otter", "Labs", "Systems", None, " ", "Saltmarsh Pump Makers LLC"]
    got = run(spark, names, seeds, 90.0)
    assert got == sequential(names, seeds, 90.0)
    assert [m for _, m, _ in got] == [
        "exact", "exact", "normalized", "new_entity", "normalized", "fuzzy", "new_entity", "new_entity",
        "normalized", "skipped_empty", "skipped_empty", "exact",
    ]


def test_common_subsequence_matches_table():
    rng = random.Random(9)
    for _ in range(500):
        a = "".join(rng.choice("abcü") for _ in range(rng.randint(0, 90)))
        b = "".join(rng.choice("abcü") for _ in range(rng.randint(0, 90)))
        total = len(a) + len(b)
        want = ratio(a, b)
        assert total == 0 or (1.0 - (total - 2 * _common_subsequence(a, b)) / total) * 100.0 == want


def test_gram_size_leaves_a_shared_gram():
    for threshold in (95.0, 90.0, 85.0, 80.0, 70.0, 60.0, 40.0):
        q = gram_size(threshold)
        for n in range(1, 600):
            lost = _lost_grams(n, threshold, q)
            assert lost is None or n - q + 1 > lost


def test_normalize_agrees(spark):
    from pyspark.sql import functions as F

    from millrace.functions.names import normalized_key

    rng = random.Random(3)
    chars = "abzÜé²_-.,&' \t ́漢字5İ"
    names = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 12))) + rng.choice(["", " Inc.", " co. GmbH", "labs"]) for _ in range(800)]
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", normalized_key(F.col("name")).alias("k"))
    assert [(r.name, r.k) for r in df.collect() if r.k != normalize(r.name)] == []


def test_grid_copies_little(spark):
    """Two keys against 200,000 on one cell: copies stay below twice the input."""
    from pyspark.sql import functions as F

    from millrace.operators.similarity import grid

    counts = spark.createDataFrame([(2, 200_000), (200_000, 2), (3_000, 5_000), (1, 1)], "n_left bigint, n_right bigint")
    for r in counts.select("*", *grid(4_000)).collect():
        copies = r.n_left * r.cols + r.n_right * r.rows
        checks = -(-r.n_left // r.rows) * -(-r.n_right // r.cols)
        assert checks <= 4_000 * 1.1 + r.n_left + r.n_right
        assert min(r.n_left, r.n_right) > 100 or copies < 2 * (r.n_left + r.n_right)
    assert counts.select(F.max("n_left")).first()[0] == 200_000


def test_large_components_are_settled_in_bounded_parts(spark, monkeypatch):
    import random

    import millrace.operators.resolve as R

    rng = random.Random(4)
    edges = {(i, i + d) for i in range(40) for d in (1, rng.randint(1, 5))} | {(1000 + i, 1001 + i) for i in range(5)}
    lost = set()
    for a, b in sorted(edges, key=lambda e: e[1]):
        if a not in lost:
            lost.add(b)
    finish = R._finish_component

    def bounded(part):
        assert len(part) <= 50, len(part)
        return finish(part)

    monkeypatch.setattr(R, "_finish_component", bounded)
    limits = R.ElectionLimits(parallel_rounds=1, edges_per_task=40)
    df = spark.createDataFrame(sorted(edges), "a bigint, b bigint")
    got = R._independent_set_losers(df, R.Workspace(spark), limits)
    assert {r["b"] for r in got.collect()} == lost


def test_near_copies_meet_by_shortened_forms(spark):
    """Names that differ in digits share nearly all grams; their pairs are found without meeting all others."""
    rng = random.Random(5)
    names = {f"supplier#{i:09d}" for i in rng.sample(range(100_000), 500)}
    for text in sorted(names)[:120]:  # other lengths as well
        spot = rng.randrange(len(text))
        names |= {text[:spot] + text[spot + 1 :], text[:spot] + rng.choice("0az ") + text[spot:]}
    names = sorted({" ".join(sorted(n.split())) for n in names})
    keys = spark.createDataFrame(list(zip(names, range(len(names)))), "ts string, ord long")
    work = Workspace(spark)
    keys = work.materialize(keys.withColumn("sig", sim.signature(F.col("ts"), 90.0, sim.frequent_grams(keys, "ts", 90.0))), "keys")
    guard = sim.CellGuard(keys, 90.0, work, 1000)
    met = guard.between(keys, keys)
    found = {(r.a, r.b, round(r.score, 6)) for r in sim.similar_pairs(keys, keys, 90.0, ordered=True, **met).collect()}
    assert found == {(a, b, round(s, 6)) for i, a in enumerate(names) for b in names[i + 1 :] if (s := ratio_of(a, b)) >= 90.0}
    assert sim.expected_pairs(keys, met["plans"][0]) < len(names) ** 2 / 8 < sim.expected_pairs(keys, None)


def ratio_of(a, b):
    total = len(a) + len(b)
    return (1.0 - (total - 2 * _common_subsequence(a, b)) / total) * 100.0
