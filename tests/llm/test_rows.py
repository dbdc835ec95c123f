"""Row-wise operators: line rules, exact dedup, sharding, mixing and packing on awkward small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from contracts import LOWER, WORD
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, mixing
from millrace.llm.common import prepare
from millrace.llm.exact_dedup import ExactDedup, filter_blocks
from millrace.llm.feistel import Feistel, shuffle_shards
from millrace.llm.line_rules import apply_line_rules
from millrace.llm.mixing import poisson_mix, poisson_table
from millrace.llm.packing import best_fit, pack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy int, `odd.name` string"


def table(spark, rows):
    """Rows of (id, text, source) with columns that clash with operators' own names."""
    prepare(spark)
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "x") for i, t, s in rows], SCHEMA).repartition(3)


def awkward(seed=0):
    rng = random.Random(seed)
    words = ["a", "The", "end.", "x|y", "ÉTÉ", "été", "AB", "ab", "$$", "log in"]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["s", "t", None])) for i in range(80)]
    rows += [(100 + i, "same Text", "s") for i in range(40)] + [(200, "SAME text", None), (201, None, "s"), (202, "", "t")]
    rows += [(None, "same text", "s"), (203, "word " * 30_000, "s"), (203, "word " * 30_000, "s")]
    return rows


# --- line rules ---------------------------------------------------------------


def repeat_words(words):
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_base_counts(spark):
    rng = random.Random(2)
    rows = awkward() + [(300 + i, " ".join(rng.choices("abcd", k=60)), "s") for i in range(30)]
    got = {r["doc_id"]: r for r in apply_line_rules(table(spark, rows)).collect()}
    for doc_id, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        repeats = repeat_words(words)
        failed = len(words) < 20 or 100 * repeats > 30 * len(words)
        r = got[doc_id]
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats, failed)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (failed and r["kept"])


def test_lines_that_go(spark):
    good = [" ".join(f"w{i}x{k}" for k in range(10)) + "." for i in range(9)]
    bad = ["Home | About | Contact | Help", "ALL OF THIS LINE IS SHOUTED AT YOU!", "Please log in to read the whole of this article here.", "no mark", "a b " * 6, "$$$ *** ### money now"]
    rows = [(1, "\n\n".join(good + bad) + "\n" + good[0], "s"), (2, "\n".join(bad * 3), "s"), (3, " ".join(good), "s")]
    got = {r["doc_id"]: r for r in apply_line_rules(table(spark, rows)).collect()}
    # The repeated good line goes too.
    assert got[1]["cleaned_text"] == "\n".join(good) and got[1]["kept"]
    assert got[1]["n_failed_lines"] == len(bad) + 1
    assert not got[2]["kept"] and got[2]["cleaned_text"] == ""
    assert got[3]["cleaned_text"] == " ".join(good) and got[3]["kept"]
    assert apply_line_rules(table(spark, rows).limit(0)).filter("kept").count() == 0


# --- exact dedup --------------------------------------------------------------


def normal(text):
    return (text or "").translate(LOWER)


@pytest.mark.parametrize("bits", [1 << 29, 1 << 15])
def test_exact_dedup(spark, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "MAX_BITS", bits)
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 8)
    rows = awkward(1)
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[normal(text)].append(doc_id)
    job = ExactDedup(table(spark, rows))
    want = []
    for doc_id, text, _ in rows:
        own = groups[normal(text)]
        keep = max((i for i in own if i is not None), default=None)
        want.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256(normal(text).encode()).hexdigest()))
    assert sorted(map(tuple, job.decisions().collect()), key=repr) == sorted(want, key=repr)
    left = [tuple(r) for r in job.survivors().collect()]
    assert sorted(normal(r[1]) for r in left) == sorted(groups)
    assert all(r[0] == max((i for i in groups[normal(r[1])] if i is not None), default=None) for r in left)
    assert job.survivors().columns == table(spark, rows).columns
    empty = ExactDedup(table(spark, rows).limit(0))
    assert empty.decisions().count() == 0 and empty.survivors().count() == 0


def test_filter_size_is_bounded():
    assert filter_blocks(0) == 1 and filter_blocks(10**12) * 32768 == exact_dedup.MAX_BITS


# --- sharding -----------------------------------------------------------------


@pytest.mark.parametrize("rows", [1, 2, 3, 10, 97, 1000, 4097])
def test_feistel_is_a_permutation(rows):
    shuffle = Feistel(rows, 5)
    out = shuffle.permute(np.arange(rows))
    assert sorted(out.tolist()) == list(range(rows))
    assert (shuffle.permute(out, back=True) == np.arange(rows)).all()
    assert rows < 90 or (out != Feistel(rows, 6).permute(np.arange(rows))).mean() > 0.9


def test_shards(spark):
    rows = awkward(3)
    got = shuffle_shards(table(spark, rows), 7, 1).collect()
    texts = sorted((r[0] if r[0] is not None else -1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text_crc32"]) for r in got) == texts
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert Feistel(len(rows), 1).row_at(r["shard"], r["slot"], 7) == r["row"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert [r["row"] for r in sorted(got, key=lambda r: r["doc_id"] or -1)][0] == 0
    again = shuffle_shards(table(spark, rows).repartition(5), 7, 1).filter("doc_id < 203").collect()
    places = {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    assert all(places[r["doc_id"]] == (r["shard"], r["slot"]) for r in again)
    assert shuffle_shards(table(spark, rows).limit(0), 7).count() == 0


# --- mixing -------------------------------------------------------------------


@pytest.mark.parametrize("rate", [0.0, 0.01, 1.0, 30.5, 2000.0])
def test_poisson_table(rate):
    low, cdf = poisson_table(rate)
    assert abs(cdf[-1] - 1) < 1e-9
    mean = sum((low + k) * p for k, p in enumerate(np.diff(np.r_[0, cdf])))
    assert math.isclose(mean, rate, rel_tol=1e-6, abs_tol=1e-9)


@pytest.mark.parametrize("most", [10_000, 0])
def test_mixture(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    rows = [(i, "x" * (i % 50), ["big", "big", "big", "small", None][i % 5]) for i in range(4000)]
    docs = table(spark, rows)
    mixed = poisson_mix(docs, weights={"big": 1, "small": 1})
    mass = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(F.length("text") + 1)).collect()}
    total = sum(len(t) + 1 for _, t, _ in rows)
    assert set(mass) == {"big", "small"}
    assert all(abs(m - total / 2) < 0.06 * total for m in mass.values())
    got = [(r["doc_id"], r["mix_copy"]) for r in mixed.collect()]
    copies = Counter(i for i, _ in got)
    assert all({c for i, c in got if i == d} == set(range(copies[d])) for d in list(copies)[:50])
    order = [r["mix_order"] for r in mixed.collect()]
    assert order == sorted(order)
    again = poisson_mix(docs.repartition(7), weights={"big": 1, "small": 1}).select("doc_id", "mix_copy").collect()
    assert [tuple(r) for r in again] == got


def test_mixture_edges(spark):
    rows = awkward(4)
    mixed = poisson_mix(table(spark, rows), total=3.0)
    assert {r["doc_id"] for r in mixed.collect()} <= {r[0] for r in rows}
    assert poisson_mix(table(spark, rows).limit(0)).count() == 0
    assert poisson_mix(table(spark, rows), weights={"none": 1.0}).count() == 0


# --- packing ------------------------------------------------------------------


def plain_best_fit(lengths, sources, clusters, capacity):
    """Tightest compatible bin by looking at all of them."""
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(b["rest"], k) for k, b in enumerate(bins) if b["rest"] >= n and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"rest": capacity, "s": set(), "c": set()})
        out.append((k, capacity - bins[k]["rest"]))
        bins[k]["rest"] -= n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_the_tightest(seed):
    rng = random.Random(seed)
    n = 200
    lengths = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
    sources, clusters = [rng.randint(-1, 12) for _ in range(n)], [rng.randint(-1, 60) for _ in range(n)]
    assert list(zip(*best_fit(lengths, sources, clusters, 100))) == plain_best_fit(lengths, sources, clusters, 100)


def test_packing(spark):
    rng = random.Random(9)
    rows = awkward(5) + [(1000 + i, "w " * rng.randint(1, 130), f"s{rng.randint(0, 6)}") for i in range(300)]
    placed = pack(table(spark, rows), capacity=64, group_pieces=100).collect()
    sizes = Counter()
    for doc_id, text, _ in rows:
        sizes[doc_id] += len(WORD.findall(text or ""))
    words, used = Counter(), defaultdict(list)
    source = {i: s for i, _, s in rows}
    for r in placed:
        words[r["doc_id"]] += r["length"]
        if r["bin"] is None:
            assert r["length"] == 0
            continue
        used[r["pack_group"], r["bin"]].append(r)
    assert words == sizes or +words == +sizes
    for own in used.values():
        spans = sorted((r["bin_offset"], r["bin_offset"] + r["length"]) for r in own)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 64
        ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
        assert len(ids) == len(set(ids))
        named = [source[r["doc_id"]] for r in own if source[r["doc_id"]] is not None]
        assert len(named) == len(set(named))
    assert len({r["pack_group"] for r in placed if r["bin"] is not None}) > 3
    assert pack(table(spark, rows).limit(0)).count() == 0
