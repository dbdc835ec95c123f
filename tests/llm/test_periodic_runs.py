"""Periodic runs against all periods tried in turn."""

import hashlib
import random
import zlib

import pytest
from contracts import WORD

from millrace.llm.common import prepare
from millrace.llm.periodic_runs import periodic_runs, runs_of, word_runs
from millrace.llm.queries import repeated_periods


def all_runs(words, least):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            stretch = words[i : i + length]
            smallest = not any(all(stretch[k] == stretch[k + d] for k in range(length - d)) for d in range(1, q))
            if length >= max(least, 2 * q) and smallest:
                found.append((i, length, q))
            i = j
    return sorted(found)


def random_words(rng):
    n = rng.randint(0, 90)
    words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        start, period = rng.randint(0, n), rng.randint(1, 12)
        for i in range(start + period, min(n, start + rng.randint(1, 60))):
            words[i] = words[i - period]
    return words


@pytest.mark.parametrize("least", [2, 12])
def test_runs_like_all_periods(least):
    rng = random.Random(least)
    for _ in range(400):
        words = random_words(rng)
        want = all_runs(words, least)
        assert runs_of([ord(w) for w in words], least) == want
        assert word_runs([w.encode() for w in words], least) == want


def test_long_periodic_text():
    words = [b"a", b"b", b"a", b"c"] * 20_000
    assert word_runs([b"x", *words, b"y"], 12) == [(1, 80_000, 4)]
    assert word_runs([b"z"] * 30_000, 12) == [(0, 30_000, 1)]


def test_edges_of_the_input(spark):
    prepare(spark)
    rows = [
        (1, None, "n"), (2, "", "n"), (3, " \t\n", "n"), (4, "a " * 11, "n"), (5, "a\n" * 12, "n"), (5, "x " + "b c " * 8 + "d", "n"),
        (None, "é " * 20, "n"), (7, "one two three", "n"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in periodic_runs(df).collect())
    assert got == sorted(
        [
            (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 11, [], " ".join("a" * 11)), (5, 12, [(0, 12, 1)], "a"),
            (5, 18, [(1, 16, 2)], "x b c d"), (0, 20, [(0, 20, 1)], "é"), (7, 2, [], "one two three"),
        ]
    )
    assert periodic_runs(df.limit(0)).count() == 0


def contract(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *row, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_like_its_contract(spark):
    source = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{source}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in repeated_periods(spark, source).collect()}
    short = [r for r in rows if len((r.text or "").split()) < 700]
    assert len(got) == len(rows) and len(short) > 100
    assert {r.doc_id: got[r.doc_id] for r in short} == {r.doc_id: contract(*r) for r in short}
    assert sum(1 for r in short if got[r.doc_id][0]) > 5
