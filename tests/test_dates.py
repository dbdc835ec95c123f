"""Truth table of date strings, and agreement with the general parser on mixed input."""

import random
import re
import warnings
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates as d

REF = datetime(2026, 9, 12, 12, 0, 0, tzinfo=timezone.utc)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def parse(spark, raws, ref=REF):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    p = d.normalize_date(F.col("raw"), ref)
    rows = df.select("i", p.alias("p")).select(
        "i", F.unix_micros("p.value").alias("us"), "p.confidence", "p.reason", d.is_fresh(F.col("p.value"), ref).alias("fresh")
    )
    return [
        (EPOCH + timedelta(microseconds=r.us) if r.us is not None else None, r.confidence, r.reason, r.fresh)
        for r in rows.orderBy("i").collect()
    ]


def test_truth_table(spark):
    at = lambda *a: datetime(*a, tzinfo=timezone.utc)
    table = {
        "2026-09-12T10:00:00Z": (at(2026, 9, 12, 10), "exact", True),
        "2 hours ago": (REF - timedelta(hours=2), "relative_exact", True),
        "30 minutes ago": (REF - timedelta(minutes=30), "relative_exact", True),
        "Today": (REF, "relative_exact", True),
        "Yesterday": (REF - timedelta(days=1), "relative_exact", True),
        None: (None, "unknown", False),
        "Sep 12": (REF, "heuristic", True),
        "5 hours ago": (REF - timedelta(hours=5), "relative_exact", True),
        "2026-09-11T12:00:00Z": (at(2026, 9, 11, 12), "exact", True),
        "2026-09-10T00:00:00Z": (at(2026, 9, 10), "exact", False),
        "soon, we hope (?)": (None, "unknown", False),
        "2026-09-11": (at(2026, 9, 11, 12), "exact", True),
        "2026-09": (REF, "exact", True),
        "20260912": (REF, "heuristic", True),
        "10:30": (at(2026, 9, 12, 10, 30), "heuristic", True),
        "Monday": (at(2026, 9, 14, 12), "heuristic", False),
        "12/09/2026": (at(2026, 12, 9, 12), "exact", False),
        "13/09/2026": (at(2026, 9, 13, 12), "exact", False),
        "2026-09-12T10:00:00+05:30": (at(2026, 9, 12, 4, 30), "exact", True),
        "3 months ago": (None, "unknown", False),
        "an hour ago": (None, "unknown", False),
        "2026-02-30": (None, "unknown", False),
        "9" * 30 + " weeks ago": (None, "unknown", False),
    }
    got = parse(spark, list(table))
    for raw, (value, confidence, _, fresh) in zip(table, got):
        assert (value, confidence, fresh) == table[raw], raw


def test_reasons(spark):
    reasons = [r for _, _, r, _ in parse(spark, [None, " ", "TODAY", "2 Hours  ago", "2026-09-11", "Sep 1", "it's", 'say "it\'s"', "a\\b\tc"])]
    assert reasons == [
        "missing_date_string", "missing_date_string", "relative:today", "relative:2_hour_ago", "absolute_parsed",
        "absolute_parsed_year_inferred_from_reference_time", "unparseable:\"it's\"", "unparseable:'say \"it\\'s\"'",
        "unparseable:'a\\\\b\\tc'",
    ]


@pytest.mark.parametrize("ref", [REF.replace(minute=34, second=56, microsecond=789), datetime(2024, 2, 29, 1, 2, 3, tzinfo=timezone.utc)])
def test_agrees_with_general_parser(spark, ref):
    from dateutil import parser

    rng = random.Random(5)
    months = ["Jan", "february", "MAR.", "Sept", "Oct", "Feb", "dec", "May"]

    def one():
        y, m, day = rng.randint(1, 2999), rng.randint(0, 14), rng.randint(0, 33)
        h, mi, s = rng.randint(0, 25), rng.randint(0, 61), rng.randint(0, 61)
        zone = rng.choice(["", "Z", "+05:30", "-0800", " UTC", " +01:00", "+23:59"])
        return rng.choice(
            [
                f"{y:04d}-{m:02d}-{day:02d}", f"{y:04d}-{m:02d}-{day:02d}T{h:02d}:{mi:02d}:{s:02d}{zone}",
                f"{y:04d}-{m:02d}-{day:02d} {h:02d}:{mi:02d}{zone}", f"{y:04d}-{m:02d}-{day:02d}T{h:02d}:{mi:02d}:{s:02d}.{rng.randint(0, 10**8)}{zone}",
                f"{rng.choice(months)} {day}", f"{rng.choice(months)} {day}, {y:04d}", f"{day} {rng.choice(months)} {y:04d}", f"{day} {rng.choice(months)}",
                f"{y:04d}{m:02d}{day:02d}", f"{y:04d}-{m}-{day}", f"{y:04d}/{m:02d}/{day:02d}", f"{h}:{mi:02d}", f"{h:02d}:{mi:02d}:{s:02d}.{rng.randint(0, 9999)}{zone}",
                f"{rng.choice(months)} {day}, {y:04d} at {h}:{mi:02d}{zone}", f"{day} {rng.choice(months)} {y:04d} {h:02d}:{mi:02d}:{s:02d}{zone}",
                f"{m}/{day}/{y:04d}", f"{day}/{m}/{y:04d}", f"Tue, {day:02d} {rng.choice(months)} {y:04d} {h:02d}:{mi:02d}:{s:02d}{rng.choice([' GMT', ' +0200', ''])}",
            ]
        )

    raws = [one() for _ in range(1500)]
    expected = []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for raw in raws:
            try:
                moment = parser.parse(raw, default=ref)
                moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
                expected.append(moment.astimezone(timezone.utc))
            except (ValueError, OverflowError):
                expected.append(None)
    found = parse(spark, raws, ref)
    assert [(r, g, e) for r, (g, *_), e in zip(raws, found, expected) if g != e] == []
    for raw, (value, confidence, reason, _) in zip(raws, found):
        year = bool(re.search(r"\b\d{4}\b", raw))
        assert confidence == ("unknown" if value is None else "exact" if year else "heuristic"), raw
        assert value is not None or reason == f"unparseable:{raw!r}"


def test_known_shapes_need_no_general_parser(spark):
    raws = ["10:30", "9:05:07", "20230930", "2023-1-9", "2023/11/09", "Sep 5 2023 at 10:00", "5 September 2023 10:00:01Z", "3 days ago", "12/31/2023"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    value = d.normalize_date(F.col("raw"), REF, general=False)["value"]
    assert df.filter(value.isNull()).count() == 0


def test_table_form_equals_column_form(spark):
    raws = [None, "", "Today", "yesterday", "3 hours ago", "٣ hours ago", "5 months ago", "it's long ago", "10:30 AGO", "Monday", "2023-02-30", "20230930", "a~b", "1~day ago"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    column = df.select("i", d.normalize_date(F.col("raw"), REF).alias("p")).orderBy("i").collect()
    table = d.with_dates(df, "p", F.col("raw"), REF)
    assert table.columns == ["i", "raw", "p"]
    assert table.select("i", "p").orderBy("i").collect() == column
    assert column[6].p.reason == "unparseable:'5 months ago'" and column[7].p.reason == "unparseable:\"it's long ago\""


def test_window_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ref = F.lit("2024-01-30 18:00:00").cast("timestamp_ntz")
    plan = df.filter(d.in_window(F.col("ts"), ref))._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed
