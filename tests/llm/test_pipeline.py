"""The corpus pipeline, stage by stage, against plain Python on the smallest table."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from contracts import LOWER, WORD, jaccard_components

from millrace.llm import line_rules as rules

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def line_fails(line):
    words = WORD.findall(line)
    bare = re.sub(r"[\x20\x09-\x0D]+$", "", line)
    separators = sum(line.count(c) for c in rules.SEPARATORS)
    return (
        20 * sum(line.count(c) for c in rules.SYMBOLS) > len(line)
        or (len(words) < rules.SHORT_LINE and not re.search(rules.CLOSING, bare))
        or (len(words) >= 5 and 2 * len(re.findall("[A-Z]", line)) > len(re.findall("[A-Za-z]", line)))
        or (separators >= 3 and separators * 6 >= len(words))
        or (len(words) <= rules.BOILERPLATE_WORDS and any(p in line.lower() for p in rules.BOILERPLATE))
        or (len(words) >= 10 and 5 * len(set(words)) < len(words))
    )


def cleaned(text):
    """The text without failing lines, None for a rejected document."""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    good = list(dict.fromkeys(x for x in lines if not line_fails(x)))
    lost = sum(map(len, lines)) - sum(map(len, good))
    if len(words) < 20 or 100 * len(covered) > 30 * len(words) or 2 * lost > sum(map(len, lines)):
        return None
    return text if len(good) == len(lines) else "\n".join(good)


def poisson(rate, u):
    total, k = 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if total > u or k > 200:
            return k
        k += 1


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality rules", "exact dedup", "n-gram Jaccard join", "source mixing", "best-fit packing"]

    kept = {i: t for i, r in rows.items() if (t := cleaned(r["text"] or "")) is not None}
    docs = stages["quality rules"](spark, docs, SF).cache()
    assert docs.columns == COLUMNS
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()} == {i: (t, len(t)) for i, t in kept.items()}

    last = {t.translate(LOWER): i for i, t in sorted(kept.items())}
    docs = stages["exact dedup"](spark, docs, SF).cache()
    assert docs.columns == COLUMNS and sorted(r["doc_id"] for r in docs.collect()) == sorted(last.values())

    found = jaccard_components([(i, kept[i]) for i in last.values()], 5, 80)
    left = sorted(i for i, (_, component) in found.items() if component == i)
    docs = stages["n-gram Jaccard join"](spark, docs, SF).cache()
    assert docs.columns == COLUMNS and sorted(r["doc_id"] for r in docs.collect()) == left

    mass = Counter()
    for i in left:
        mass[rows[i]["source"]] += len(kept[i].encode()) + 1
    scale = sum(mass.values()) / sum(math.sqrt(m) for m in mass.values())
    copies = Counter()
    for i in left:
        u = int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        copies[i] += poisson(scale / math.sqrt(mass[rows[i]["source"]]), u)
    docs = stages["source mixing"](spark, docs, SF).cache()
    assert docs.columns == COLUMNS and Counter(r["doc_id"] for r in docs.collect()) == +copies

    placed = stages["best-fit packing"](spark, docs, SF).collect()
    bins, words = defaultdict(list), Counter()
    for r in placed:
        bins[r["pack_group"], r["bin"]].append(r)
        words[r["doc_id"]] += r["length"]
    assert words == Counter({i: n * len(WORD.findall(kept[i])) for i, n in (+copies).items()})
    for own in bins.values():
        assert sum(r["length"] for r in own) <= 2048
        assert len({r["doc_id"] for r in own}) == len(own) == len({rows[r["doc_id"]]["source"] for r in own})


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is pipeline.run and pipeline.ORACLE_SQL is None


def test_empty_table_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    # Further columns, some with names that the operators use themselves, and nulls in any column.
    text = " ".join(f"word{i}" for i in range(40)) + "."
    rows = [(1, text, "en", "a", 240, 7, "k", 1.0, True), (2, text, None, None, None, None, None, None, None), (None, None, None, None, None, 3, "", 0.0, False)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size double, kept boolean"
    clashing = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, clashing, SF)
        kept[name] = out.collect()
        if name != "best-fit packing":
            assert out.columns == COLUMNS
    assert {r.doc_id for r in kept["quality rules"]} == {1, 2}
    assert {r.doc_id for r in kept["exact dedup"]} == {2, None}
    assert {r.doc_id for r in kept["n-gram Jaccard join"]} == {1, None}
    assert len(kept["best-fit packing"]) == 3
