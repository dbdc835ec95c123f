"""The provider chain with mock providers."""

import json
import sys
import time
import uuid
import zlib
from datetime import datetime
from pathlib import Path

import pytest
from pyspark import cloudpickle

from millrace.functions.prompts import TEXT_CLOSE, TEXT_OPEN
from millrace.operators.calls import CallTimeout, run_by_due_time
from millrace.operators.extract import ALL_FAILED, STILL_TOO_LARGE, ExtractionConfig, extract
from millrace.sources.providers import PayloadTooLarge, Provider, RateLimited, TransportError, Unavailable

# Workers cannot import a test module, so its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REF = datetime(2026, 9, 12, 12)
JOB = json.dumps({"company": "Orbit", "date": "2026-08-30T06:00:00", "is_remote": False, "role_family": "Milling"})
PAPER = json.dumps({"title": "T", "authors": ["A"], "paper_url": "u", "github_stars": 77})
STARTUP = json.dumps({"entityName": "Orbit", "data": {"employeeCount": 10}})


def no_wait(_):
    return None


def body(prompt):
    return prompt.split(TEXT_OPEN, 1)[1].rsplit(TEXT_CLOSE, 1)[0]


def failing(error):
    def complete(prompt):
        raise error("mock")

    return complete


def docs(spark, record_type, *texts):
    rows = [(i, record_type, t, "site", f"https://e.x/{i}", REF) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id bigint, record_type string, raw_text string, source_name string, source_url string, reference_time timestamp"
    )


def run(spark, record_type, texts, providers, **config):
    result = extract(docs(spark, record_type, *texts), providers, ExtractionConfig(sleep=no_wait, partitions=2, **config), (record_type,))
    attempts = result.attempts.collect()
    return result, attempts


def test_rate_limit_falls_through_after_all_retries(spark):
    result, attempts = run(
        spark, "RESEARCH_PAPER", ["paper " * 20],
        [Provider("one", failing(RateLimited)), Provider("two", lambda p: PAPER), Provider("three", lambda p: PAPER)],
    )
    row = result.entities("RESEARCH_PAPER").first()
    assert row.content.github_stars == 77 and row.source.url == "https://e.x/0" and row.schemaVersion == "1.0"
    assert sorted((a.provider, a.attempt, a.outcome) for a in attempts) == [
        ("one", 1, "rate_limited"), ("one", 2, "rate_limited"), ("one", 3, "rate_limited"), ("two", 1, "ok"),
    ]
    waits = sorted(a.wait_seconds for a in attempts if a.provider == "one")
    assert waits[0] == 0 and 1.5 <= waits[1] <= 2.25 and 3.0 <= waits[2] <= 4.5


def test_too_large_is_halved_and_restarts_at_first_provider(spark):
    def small_only(prompt):
        if len(body(prompt)) > 5000:
            raise PayloadTooLarge("mock")
        return JOB

    result, attempts = run(spark, "JOB", ["We look for a miller at the river. " * 260], [Provider("one", small_only), Provider("two", lambda p: JOB)])
    rows = result.outcomes.collect()
    assert [(r.status, r.sub_index, r.provider) for r in rows] == [("entity", 0, "one")]
    assert sorted((a.provider, tuple(a.path)) for a in attempts) == [("one", ()), ("one", (0,)), ("one", (1,))]


def test_splits_end_and_every_chunk_has_one_outcome(spark):
    text = "\n\n".join(f"P{i}: " + "x" * 10 for i in range(4))

    def picky(prompt):
        if "P2" in body(prompt):
            raise PayloadTooLarge("mock")
        return STARTUP

    result, _ = run(spark, "STARTUP", [text], [Provider("one", picky)], max_tokens_per_chunk=5, max_chunk_splits=2)
    rows = sorted(result.outcomes.collect(), key=lambda r: r.chunk_index)
    assert [r.status for r in rows] == ["entity"] * 4
    assert [r.sub_index for r in rows] == [0, 1, 201, 3]
    stuck, _ = run(spark, "STARTUP", ["abcdefgh"], [Provider("one", failing(PayloadTooLarge)), Provider("two", lambda p: STARTUP)], max_chunk_splits=2)
    assert [(r.chunk_index, r.reason) for r in stuck.failures().collect()] == [(0, STILL_TOO_LARGE)]


@pytest.mark.parametrize(
    "first",
    [lambda p: "{\"company\": ", failing(Unavailable), failing(TransportError), lambda p: '{"entityName": 5}', lambda p: "[]", failing(KeyError)],
    ids=["bad-json", "unavailable", "transport", "schema", "array", "unexpected"],
)
def test_bad_reply_goes_to_next_provider(spark, first):
    result, _ = run(spark, "STARTUP", ["Orbit has 10 people."], [Provider("one", first), Provider("two", lambda p: STARTUP)], max_retries_per_provider=1)
    assert [(r.status, r.provider) for r in result.outcomes.collect()] == [("entity", "two")]


def test_skip_empty_and_unconfigured(spark):
    skip, _ = run(spark, "PRODUCT", ["nothing here", "<script>x</script> "], [Provider("one", lambda p: '{"__skip__": true}')])
    assert [(r.doc_id, r.status, r.reason, r.detail) for r in skip.outcomes.collect()] == [(0, "failure", ALL_FAILED, "no_entity")]
    none, attempts = run(spark, "PRODUCT", ["text"], [Provider("one", lambda p: "{}", "MILLRACE_NO_SUCH_KEY")])
    assert [(r.status, r.reason) for r in none.outcomes.collect()] == [("failure", ALL_FAILED)] and attempts == []


def busy_counter(folder):
    """Every call notes how many calls are in flight; the first try of each text is turned away."""

    def complete(prompt):
        own, text = Path(folder, f"call-{uuid.uuid4().hex}"), body(prompt).strip()
        own.touch()
        Path(folder, f"seen-{own.name}").write_text(str(len(list(Path(folder).glob("call-*")))))
        time.sleep(0.02)
        own.unlink()
        tried = Path(folder, f"tried-{zlib.crc32(text.encode())}")
        if not tried.exists():
            tried.touch()
            raise RateLimited("mock")
        return PAPER

    return complete


def test_calls_in_flight_over_the_job(spark, tmp_path):
    texts = [f"paper {i}" for i in range(40)]
    config = ExtractionConfig(concurrency=3, partitions=8, base_backoff_seconds=0.01)
    result = extract(docs(spark, "RESEARCH_PAPER", *texts), [Provider("one", busy_counter(str(tmp_path)))], config, ("RESEARCH_PAPER",))
    assert result.entities("RESEARCH_PAPER").count() == 40
    seen = [int(p.read_text()) for p in tmp_path.glob("seen-*")]
    assert len(seen) == 80 and max(seen) <= 3


def test_waiting_rows_hold_no_permit():
    order = []

    def row(name, pause):
        yield lambda: order.append(f"{name} asks")
        yield pause
        yield lambda: order.append(f"{name} again")
        return name

    started = time.monotonic()
    assert run_by_due_time([row("a", 0.3), row("b", 0.1), row("c", 0.2)], 1, time.sleep) == ["a", "b", "c"]
    assert order == ["a asks", "b asks", "c asks", "b again", "c again", "a again"]
    assert time.monotonic() - started < 0.55
    order.clear()
    started = time.monotonic()
    assert run_by_due_time([row("a", 1000.0), row("b", 10.0)], 2, no_wait) == ["a", "b"]
    assert order[-2:] == ["b again", "a again"] and time.monotonic() - started < 5


def test_call_time_limit():
    def row(seconds):
        try:
            yield lambda: time.sleep(seconds)
        except CallTimeout:
            return "late"
        return "in time"

    assert run_by_due_time([row(0.6), row(0.0), row(0.0)], 2, time.sleep, limit=0.2) == ["late", "in time", "in time"]


def test_a_late_row_asks_again_and_errors_of_calls_reach_the_caller():
    order = []

    def row():
        try:
            yield lambda: time.sleep(0.4) or order.append("back")
        except CallTimeout:
            yield lambda: order.append("again")
        return "done"

    # The late call keeps the only permit until it is back.
    assert run_by_due_time([row()], 1, time.sleep, limit=0.1) == ["done"] and order == ["back", "again"]

    def stopped():
        yield lambda: sys.exit(3)

    with pytest.raises(SystemExit):
        run_by_due_time([stopped(), stopped()], 2, time.sleep)


def test_a_wave_writes_one_table_without_texts_that_led_to_entities(spark):
    texts = ["good " * 30, "bad " * 30]
    first = Provider("one", lambda p: STARTUP if "good" in body(p) else "{broken")
    result, attempts = run(spark, "STARTUP", texts, [first, Provider("two", lambda p: STARTUP)])
    assert {r.doc_id: r.provider for r in result.outcomes.collect()} == {0: "one", 1: "two"} and len(attempts) == 3
    tables = {f.rsplit("/", 1)[0] for f in result.outcomes.inputFiles()}
    folder = Path(next(iter(tables)).removeprefix("file://").removeprefix("file:")).parent
    assert len(tables) == len(list(folder.iterdir())) == 2
    for table in tables:
        assert {(r.content is None, r.text is None) for r in spark.read.parquet(table).collect()} <= {(True, False), (False, True)}
