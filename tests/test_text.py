"""Chunking and text functions against plain Python, on random documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.patterns import SPACE_CHARS
from millrace.operators.chunking import chunk_documents


def plain_chunks(raw, limit):
    for pattern, flags in ((r"<script.*?</script>", re.S | re.I), (r"<style.*?</style>", re.S | re.I), (r"<!--.*?-->", re.S)):
        raw = re.sub(pattern, " ", raw, flags=flags)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", raw)).strip()
    done, current = [], []
    for para in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        if len(para) > limit:
            done += ["\n\n".join(current)] * bool(current) + [para[i : i + limit] for i in range(0, len(para), limit)]
            current = []
        elif len("\n\n".join([*current, para])) > limit:
            done.append("\n\n".join(current))
            current = [para]
        else:
            current.append(para)
    return done + ["\n\n".join(current)] * bool(current)


def documents(n):
    rng = random.Random(11)
    bits = ["alpha", "bé", "漢字", "😀x", " ", "\t", "\n", "\n\n", "\n \n", "\n \n", "\n\n\n\n", "<SCRIPT>a\nb</script>", "<!-- c -->", "<style>", "word " * 9, "\x1c", "\x85"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("tokens", [2, 10, 30])
def test_chunks_equal_plain_python(spark, tokens):
    docs = documents(400)
    df = spark.createDataFrame(list(enumerate(docs)), "i int, raw string")
    got = {i: [] for i in range(len(docs))}
    for r in chunk_documents(df, "raw", max_tokens=tokens).orderBy("i", "chunk_index").collect():
        assert r.chunk_index == len(got[r.i]) and r.approx_tokens == max(1, len(r.chunk_text) // 4)
        got[r.i].append(r.chunk_text)
        assert r.total_chunks == len(plain_chunks(docs[r.i], tokens * 4))
    assert [(i, g, plain_chunks(docs[i], tokens * 4)) for i, g in got.items() if g != plain_chunks(docs[i], tokens * 4)] == []


def test_limits(spark):
    assert tx.max_chunk_chars(6000) == 24000 and tx.max_chunk_chars(20000) == 40000
    with pytest.raises(ValueError):
        tx.max_chunk_chars(0)


def test_each_document_is_packed_once(spark):
    df = spark.createDataFrame([(1, "x")], "i int, raw string")
    plan = chunk_documents(df, "raw", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and "Filter" not in plan


def test_strip_and_halves(spark):
    assert sorted(SPACE_CHARS) == [chr(i) for i in range(0x110000) if chr(i).isspace()]
    texts = ["", "a", "ab", "abc", "😀é漢"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(tx.midpoint_halves(F.col("t"))).collect()] == [[t[: len(t) // 2], t[len(t) // 2 :]] for t in texts]


def test_boilerplate_patterns_run_only_where_they_can_occur(spark):
    texts = ["a b\nc", "a\tb", "\t", "a  b", "a \t b\n\n\n\nc", "x<SCRIPT>1</script>y<style>\n</STYLE>z<!-- c\n-->", "<script>  ", "a < b\n\n\nc  ", "\n\n\n", "", None]

    def plain(text):
        for pattern, put in ((r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
            text = re.sub(pattern, put, text)
        return text.strip()

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.c for r in rows.select("id", tx.strip_boilerplate(F.col("t")).alias("c")).collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}
