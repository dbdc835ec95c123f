"""Streaming resolution over several batches equals one sequential pass."""

import random

from brute import sequential
from test_resolve import SEEDS, random_names

from millrace.streaming import gates


def test_resolving_sink_over_batches(spark, tmp_path):
    names = random_names(random.Random(21), 120)
    source = tmp_path / "in"
    schema = "id bigint, name string"
    for part in range(3):
        rows = list(enumerate(names))[part * 40 : part * 40 + 40]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    seeds = spark.createDataFrame([(i, c, a) for i, (c, a) in enumerate(SEEDS)], "position bigint, canonical string, alias string")
    sink = gates.ResolvingSink(seeds, "name", "id", str(tmp_path / "out"))
    gates.drain_batches(stream, sink, str(tmp_path / "ckpt"))
    rows = sink.resolved().orderBy("id").collect()
    assert {r.batch for r in rows} == {0, 1, 2}
    # A replay of the last batch changes nothing.
    last = spark.createDataFrame([(r.id, r.name) for r in rows if r.batch == 2], schema)
    sink(last, 2)
    again = sink.resolved().orderBy("id").collect()
    assert again == rows
    assert [(r.canonical_name, r.method, r.confidence) for r in rows] == sequential(names, SEEDS, 90.0)


def test_repeated_key_passes_once(spark, tmp_path):
    from datetime import datetime

    rows = [("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 1, 1)), ("b", datetime(2024, 1, 1, 2))]
    spark.createDataFrame(rows, "k string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    first = gates.stream_first_seen(stream, ["k"], "ts", "1 day").select("k")
    gates.drain(first, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
