import json

from pyspark.sql import functions as F

from millrace.functions.records import validate_reply


def judge(spark, record_type, payloads):
    rows = [(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "i int, reply string").select(
        "i", validate_reply(F.col("reply"), F.lit(record_type)).alias("v")
    )
    return [
        (r.v.reject, r.v.errors, json.loads(r.v.content) if r.v.content else None) for r in df.orderBy("i").collect()
    ]


def test_int_coercion(spark):
    values = ["10", " 10 ", "10.0", "10.", "10.5", "1_000", "1__0", "+5", "1e3", "", True, 10, 10.0, 10.5, None, [1], 1e20]
    got = judge(spark, "STARTUP", [{"entityName": "A", "data": {"employeeCount": v}} for v in values])
    counts = [c["data"]["employeeCount"] if c else "bad" for _, _, c in got]
    assert counts == [10, 10, 10, "bad", "bad", 1000, "bad", 5, "bad", "bad", 1, 10, 10, "bad", None, "bad", "bad"]
    assert got[3][1] == ["data.employeeCount:type"]


def test_bool_coercion(spark):
    values = ["yes", "No", "ON", "t", "1", "2", " true", 1, 0, 2, 1.0, 0.5, True, None]
    got = judge(spark, "JOB", [{"company": "A", "is_remote": v} for v in values])
    assert [c["is_remote"] if c else "bad" for _, _, c in got] == [
        True, False, True, True, True, "bad", "bad", True, False, "bad", True, "bad", True, None,
    ]


def test_datetime_coercion(spark):
    cases = {
        "2026-09-10": "2026-09-10T00:00:00", "2026-09-10T10:00": "2026-09-10T10:00:00",
        "2026-09-10 00:00:00": "2026-09-10T00:00:00", "2026-09-10T00:00:00.123456789": "2026-09-10T00:00:00.123456",
        "2026-09-10T00:00:00z": "2026-09-10T00:00:00Z", "2026-09-10t00:00:00+0530": "2026-09-10T00:00:00+05:30",
        "2026-09-10T00:00:00+05": "bad", "2026-9-1": "bad", "2026-02-30": "bad", "1757462400": "2025-09-10T00:00:00Z",
        "1757462400000": "2025-09-10T00:00:00Z", "1757462400.5": "2025-09-10T00:00:00.500000Z", "Sep 12": "bad",
        "20260912": "1970-08-23T12:01:52Z", "2026-09-10T24:00:00": "bad", "-5": "1969-12-31T23:59:55Z",
        "2026-09-10T10:00:60": "bad",
    }
    got = judge(spark, "NEWS", [{"title": "t", "published_date": v} for v in cases])
    assert [c["published_date"] if c else "bad" for _, _, c in got] == list(cases.values())
    assert [c and c["published_date"] for _, _, c in judge(spark, "NEWS", [{"title": "t", "published_date": v} for v in (1757462400, True, 1.5)])] == [
        "2025-09-10T00:00:00Z", None, "1970-01-01T00:00:01.500000Z",
    ]


def test_required_enum_lists_and_unknown_keys(spark):
    got = judge(
        spark,
        "RESEARCH_PAPER",
        [
            {"title": "t", "paper_url": "u", "extra": 1},
            {"title": "t", "paper_url": "u", "authors": ["a", "b"]},
            {"title": "t", "paper_url": "u", "authors": None},
            {"title": "t", "paper_url": "u", "authors": ["a", 1]},
            {"title": 5, "github_stars": "x"},
        ],
    )
    assert got[0][2]["authors"] == [] and "extra" not in got[0][2]
    assert got[1][2]["authors"] == ["a", "b"]
    assert got[2][1] == ["authors:type"] and got[3][1] == ["authors:type"]
    assert got[4][1] == ["title:type", "paper_url:missing", "github_stars:type"]
    prices = judge(spark, "PRODUCT", [{"startupName": "s", "pricingModel": p} for p in ("FREE", "free", None, "")])
    assert [r for r, _, _ in prices] == [None, "schema", None, "schema"]
    data = judge(spark, "STARTUP", [{"entityName": "A"}, {"entityName": "A", "data": None}, {"entityName": "A", "data": {}}])
    assert [r for r, _, _ in data] == [None, "schema", None]
    assert data[0][2] == {"entityName": "A", "data": {"employeeCount": None}}


def test_skip_fences_and_bad_json(spark):
    good = json.dumps({"title": "t"})
    replies = ["not json {{{", "[1, 2]", "7", f"```json\n{good}\n```", f"```{good}```", f"  {good}  ", '{"__skip__": true}',
               '{"__skip__": "false"}', '{"__skip__": 0, "title": "t"}', '{"__skip__": [], "title": "t"}', '{"__skip__": {"a": 1}}',
               '{"__skip__": null, "title": "t"}', '{"__skip__": "", "title": "t"}', '{"__skip__": 0.5}']
    assert [r for r, _, _ in judge(spark, "NEWS", replies)] == [
        "invalid_json", "invalid_json", "invalid_json", None, "invalid_json", None, "no_entity", "no_entity", None, None,
        "no_entity", None, None, "no_entity",
    ]
