from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, observe
from millrace.plans import outputs as out
from millrace.schemas import OUTPUT_COLUMNS, RECORD_TYPES, content_struct, entity_struct, json_schema
from millrace.session import Workspace
from millrace.sinks import files
from millrace.sinks.commit import TableSet
from millrace.sources.seeds import read_seed_file, seed_aliases

REF = datetime(2026, 9, 12, 12, 30, 5, 250000)


@pytest.fixture(scope="module")
def tables(spark):
    startups = spark.createDataFrame(
        [(0, "Orbit", 500, 'says "hi", twice\nand more', "https://e.x/orbit"), (1, "Kestrel", None, "flies", "https://e.x/kestrel")],
        "ordinal bigint, entityName string, employeeCount int, description string, source_url string",
    )
    papers = spark.createDataFrame([("T", "https://arxiv.org/abs/2608.1", "https://github.com/a/b", 7)], "title string, paper_url string, github_url string, github_stars int")
    jobs = spark.createDataFrame(
        [(0, "Orbit Inc", "Eng", "B", "j/0", "2026-09-12T00:00:00", True, "E"), (1, "Kestrel LLC", "Eng", "B", "j/1", "3 hours ago", None, "E"),
         (2, "Stale Co", "Eng", "B", "j/2", "2026-09-01", False, "E"), (3, "Stale Co", "Eng", "B", "j/3", None, False, "E")],
        "ordinal bigint, company string, title string, source_name string, source_url string, date string, is_remote boolean, role_family string",
    )
    news = spark.createDataFrame([("old", "W", "n/0", "2026-09-11T00:00:00", "x"), ("new", "W", "n/1", "Today", "y")], "title string, source_name string, source_url string, published_date string, content_excerpt string")
    seeds = seed_aliases(spark.createDataFrame([(0, "Orbit Systems", ["Orbit"])], "entity_order int, canonical string, aliases array<string>"))
    return out.build_tables(startups, out.with_paper_defaults(papers, "Daily", "https://e.x/papers"), jobs, news, seeds, REF, "Directory")


def test_build(tables):
    assert {k: tuple(v.columns) for k, v in tables.items()} == OUTPUT_COLUMNS
    log = [tuple(r) for r in tables["entity_mapping_log"].collect()]
    assert sorted(log) == sorted(
        [("Orbit", "Orbit Systems", "exact", 1.0), ("Kestrel", "Kestrel", "new_entity", 1.0), ("Orbit Inc", "Orbit Systems", "normalized", 0.97), ("Kestrel LLC", "Kestrel", "normalized", 0.97)]
    )
    assert sorted(r["content.company"] for r in tables["jobs"].collect()) == ["Kestrel", "Orbit Systems"]
    assert sorted(r["content.startupName"] for r in tables["products"].collect()) == ["Kestrel", "Orbit Systems"]
    assert [r["content.title"] for r in tables["news"].collect()] == ["new"]
    paper = tables["research_papers"].first()
    assert (paper["source.url"], paper["content.authors"], paper["content.published_date"]) == ("https://arxiv.org/abs/2608.1", "", "2026-08-01T00:00:00")
    assert paper["collectedAt"] == "2026-09-12T12:30:05.250000+00:00"


def test_csv_and_parquet(spark, tables, tmp_path):
    path = str(tmp_path / "products")
    assert files.write_table(tables["products"].withColumn("extra", F.lit(1)), path, "products", single_file=True) == 2
    back = files.read_table(spark, path)
    assert tuple(back.columns) == OUTPUT_COLUMNS["products"]
    assert 'says "hi", twice\nand more' in [r["content.description"] for r in back.collect()]
    assert [r.n_rows for r in files.rows_per_file(back).collect()] == [2]
    jobs = str(tmp_path / "jobs")
    files.write_table(tables["jobs"], jobs, "jobs")
    assert sorted(str(r["content.is_remote"]) for r in files.read_table(spark, jobs).collect()) == ["None", "True"]
    assert files.write_table(tables["jobs"], str(tmp_path / "p"), "jobs", "parquet") == 2
    assert all(len(r.preview) <= 40 for r in files.json_preview(tables["jobs"], 40).collect())


def test_tables_are_published_as_one(spark, tables, tmp_path):
    store = TableSet(spark, str(tmp_path / "store"), keep=1)
    assert store.read() == {} and store.manifest().count() == 0
    first = store.publish(tables)
    assert {k: v.count() for k, v in store.read().items()} == {k: v.count() for k, v in tables.items()}

    broken = tables["news"].withColumn("content.title", F.raise_error(F.lit("killed")).cast("string"))
    order = {k: tables[k] for k in tables if k != "news"} | {"news": broken}
    with pytest.raises(Exception, match="killed"):
        store.publish({"jobs": tables["jobs"].limit(0), **{k: order[k] for k in ("news", "products")}})
    # The six tables of the version before are still the ones in force.
    assert set(store.read()) == set(OUTPUT_COLUMNS) and store.read()["jobs"].count() == 2
    assert {r.version for r in store.manifest().collect()} == {first}

    second = store.publish({k: tables[k] for k in ("jobs", "news")})
    assert set(store.read()) == {"jobs", "news"} and second != first
    assert not (tmp_path / "store" / "data" / first).exists() and (tmp_path / "store" / "data" / second).exists()


def test_seed_file(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"entity_order": 1, "canonical": "A", "aliases": ["a1", "a2"]}\n{"entity_order": 0, "canonical": "B"}\n')
    rows = read_seed_file(spark, str(tmp_path / "s.jsonl")).orderBy("position").collect()
    assert [(r.canonical, r.alias) for r in rows] == [("B", "B"), ("A", "A"), ("A", "a1"), ("A", "a2")]


def test_schemas():
    for name in RECORD_TYPES:
        assert set(json_schema(name)["properties"]) == set(content_struct(name).fieldNames())
        assert entity_struct(name).fieldNames() == ["schemaVersion", "recordType", "source", "collectedAt", "content"]
    assert json_schema("JOB")["required"] == ["company"]


def test_changes_and_first_seen(spark):
    rows = [("k", "a", 1), ("k", "a", 2), ("k", "b", 3), ("k", "a", 5), ("k", "a", 6), ("m", "x", 4), ("n", "p", 1), ("n", "q", 9)]
    df = spark.createDataFrame(rows, "key string, h string, at int")
    got = {r["key"]: (r.first_seen, r.updated_at, r.content_hash, r.n_versions) for r in observe.track_changes(df, "key", "h", "at").collect()}
    assert got == {"k": (1, 5, "a", 2), "m": (4, 4, "x", 1), "n": (1, 9, "q", 2)}
    assert {(r["key"], r.at) for r in observe.first_seen(df, ["key"], "at").collect()} == {("k", 1), ("m", 4), ("n", 1)}
    seen = spark.createDataFrame([("k",)], "key string")
    assert {r["key"] for r in observe.unseen(df, seen, ["key"], "at").collect()} == {"m", "n"}
    pair = df.limit(1).select(observe.content_hash(F.lit("a"), F.lit("bc")) != observe.content_hash(F.lit("ab"), F.lit("c")))
    assert pair.first()[0]


def test_hops(spark, tables):
    edges = graph.builds_edges(tables["products"]).unionByName(graph.employs_edges(tables["jobs"]))
    back = edges.unionByName(graph.reverse(edges))
    starts = spark.createDataFrame([("j/1",)], "node string")
    got = graph.follow(back, starts, ["EMPLOYS_VIA_OF", "BUILDS"]).collect()
    assert [(r.start, r.node) for r in got] == [("j/1", "https://e.x/kestrel")]


def test_repeated_dates_are_read_once(spark):
    ref = datetime(2026, 9, 12, 12)
    dates = ["3 hours ago", " 3 hours ago ", "2026-09-12", "2026-09-10", "30 hours ago", "", "nonsense", "today", None] * 7
    rows = spark.createDataFrame(list(enumerate(dates)), "id int, date string")
    work = Workspace(spark)
    gated = out.fresh_by_date(rows, "date", ref, work)
    assert sorted(gated.collect()) == sorted(out.fresh_only(rows, "date", ref).collect())
    plan = gated._jdf.queryExecution().optimizedPlan().toString()
    assert gated.count() == 28 and "LeftSemi" in plan and "general_parse" not in plan
    assert spark.read.parquet(f"{work.root}/0001-dates").count() == 9
