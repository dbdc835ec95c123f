"""Date and freshness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as d
from .catalog import query, table
from .outputs import freshness_counts

# One batch time for all queries, with a time of day that date-only strings inherit.
REF = "2024-01-30 18:45:12.345678"
REF_SQL = f"TIMESTAMP '{REF}'"


def _ref():
    return F.lit(REF).cast("timestamp")


def _parsed(df, key: str, raw: str, ref=None):
    """Key, value in microseconds, confidence and reason of a raw date expression."""
    parsed = d.with_dates(df, "p", F.expr(raw), _ref() if ref is None else ref)
    return parsed.select(key, F.unix_micros("p.value").alias("value_us"), "p.confidence", "p.reason")


_UNITS = ("second", "minute", "min", "hour", "hr", "day", "week")
_UNIT = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(_UNITS)) + " END"
_UNIT_SECONDS = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {d.UNIT_SECONDS[u]}" for i, u in enumerate(_UNITS)) + " END"
_AGO = f"""CASE WHEN event_id % 3 = 0 THEN user_id || ' ' || {_UNIT} || 's ago'
    WHEN event_id % 3 = 1 THEN '  ' || user_id || {_UNIT} || ' ago ' ELSE upper(user_id || '  ' || {_UNIT} || 's  ago') END"""


@query(
    "relative_dates",
    f"""SELECT event_id, epoch_us({REF_SQL}) - user_id * {_UNIT_SECONDS} * 1000000 AS value_us, 'relative_exact' AS confidence,
        'relative:' || user_id || '_' || {_UNIT} || '_ago' AS reason FROM events""",
)
def relative_dates(spark, sf):
    return _parsed(table(spark, sf, "events", "event_id user_id"), "event_id", _AGO)


# Ages as scraped pages hold them: no-break and thin spaces, digits of another script.
_SCRAPED = f"""CASE WHEN event_id % 3 = 0 THEN user_id || '\u00a0' || {_UNIT} || 's\u2009ago'
    WHEN event_id % 3 = 1 THEN '\u2003' || translate(CAST(user_id AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' ' || {_UNIT} || '\u00a0ago'
    ELSE translate(CAST(user_id AS STRING), '0123456789', '０１２３４５６７８９') || {_UNIT} || '\u3000ago' END"""
_SCRAPED_AMOUNT = """CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR
    WHEN 1 THEN translate(user_id::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') ELSE translate(user_id::VARCHAR, '0123456789', '０１２３４５６７８９') END"""


@query(
    "scraped_ages",
    f"""SELECT event_id, epoch_us({REF_SQL}) - user_id * {_UNIT_SECONDS} * 1000000 AS value_us, 'relative_exact' AS confidence,
        'relative:' || {_SCRAPED_AMOUNT} || '_' || {_UNIT} || '_ago' AS reason FROM events""",
)
def scraped_ages(spark, sf):
    return _parsed(table(spark, sf, "events", "event_id user_id"), "event_id", _SCRAPED)


_WORDS = """CASE event_id % 6 WHEN 0 THEN 'Today' WHEN 1 THEN ' yesterday ' WHEN 2 THEN '' WHEN 3 THEN '  ' WHEN 4 THEN NULL ELSE 'TODAY' END"""


@query(
    "day_words",
    f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch_us({REF_SQL}) WHEN 5 THEN epoch_us({REF_SQL})
          WHEN 1 THEN epoch_us({REF_SQL} - INTERVAL 1 DAY) END AS value_us,
        CASE WHEN event_id % 6 IN (0, 1, 5) THEN 'relative_exact' ELSE 'unknown' END AS confidence,
        CASE event_id % 6 WHEN 0 THEN 'relative:today' WHEN 5 THEN 'relative:today' WHEN 1 THEN 'relative:yesterday'
          ELSE 'missing_date_string' END AS reason FROM events""",
)
def day_words(spark, sf):
    return _parsed(table(spark, sf, "events", "event_id"), "event_id", _WORDS)


def _per_row(cases: dict[int, str]) -> str:
    return "CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + " END"


def _formats(fmt) -> str:
    """The order date written in ten shapes; ``fmt`` names a date part in either dialect."""
    y, m, day, mon, month = (fmt(p) for p in ("year", "month", "day", "mon", "monthname"))
    return _per_row(
        {
            0: f"{y} || '-' || {m} || '-' || {day}",
            1: f"{y} || '-' || {m} || '-' || {day} || 'T10:20:30Z'",
            2: f"{y} || '-' || {m} || '-' || {day} || ' 10:20:30.5+05:30'",
            3: f"{mon} || ' ' || {day} || ', ' || {y}",
            4: f"{day} || ' ' || {month} || ' ' || {y}",
            5: f"{m} || '/' || {day} || '/' || {y}",
            6: f"'Mon, ' || {day} || ' ' || {mon} || ' ' || {y} || ' 10:20:30 -0800'",
            7: f"{mon} || ' ' || {day}",
            8: f"{y} || '-' || {m} || '-' || {day} || 'T10:20'",
            9: f"{y} || '-' || {m} || '-31T00:00:00'",
        }
    )


def _spark_part(part: str) -> str:
    pattern = {"year": "yyyy", "month": "MM", "day": "dd", "mon": "MMM", "monthname": "MMMM"}[part]
    return f"date_format(o_orderdate, '{pattern}')"


def _duck_part(part: str) -> str:
    pattern = {"year": "%Y", "month": "%m", "day": "%d", "mon": "%b", "monthname": "%B"}[part]
    return f"strftime(o_orderdate, '{pattern}')"


_DAY = "date_trunc('day', o_orderdate)"
_REF_TIME = f"({REF_SQL} - date_trunc('day', {REF_SQL}))"
# Month and day in the year of the reference; 29 February exists there (2024).
_IN_REF_YEAR = "make_timestamp(2024, month(o_orderdate), day(o_orderdate), 0, 0, 0.0)"
_MONTH_END = "try_cast(strftime(o_orderdate, '%Y-%m') || '-31' AS TIMESTAMP)"
_VALUE = _per_row(
    {
        0: f"epoch_us({_DAY} + {_REF_TIME})",
        1: f"epoch_us({_DAY}) + 37230000000",
        2: f"epoch_us({_DAY}) + 37230500000 - 19800000000",
        3: f"epoch_us({_DAY} + {_REF_TIME})",
        4: f"epoch_us({_DAY} + {_REF_TIME})",
        5: f"epoch_us({_DAY} + {_REF_TIME})",
        6: f"epoch_us({_DAY}) + 37230000000 + 28800000000",
        7: f"epoch_us({_IN_REF_YEAR} + {_REF_TIME})",
        8: f"epoch_us({_DAY}) + 37200000000 + 12345678",
        9: f"epoch_us({_MONTH_END})",
    }
)


@query(
    "absolute_dates",
    f"""WITH t AS (SELECT o_orderkey, {_formats(_duck_part)} AS raw, {_VALUE} AS value_us FROM orders)
        SELECT o_orderkey, value_us,
          CASE WHEN value_us IS NULL THEN 'unknown' WHEN o_orderkey % 10 = 7 THEN 'heuristic' ELSE 'exact' END AS confidence,
          CASE WHEN value_us IS NULL THEN 'unparseable:''' || raw || ''''
               WHEN o_orderkey % 10 = 7 THEN 'absolute_parsed_year_inferred_from_reference_time' ELSE 'absolute_parsed' END AS reason
        FROM t""",
)
def absolute_dates(spark, sf):
    return _parsed(table(spark, sf, "orders", "o_orderkey o_orderdate"), "o_orderkey", _formats(_spark_part))


# Shapes without a native reader: they take the general parser.
_GENERAL = """CASE event_id % 5
    WHEN 0 THEN lpad('' || (user_id % 24), 2, '0') || ':30'
    WHEN 1 THEN '202309' || lpad('' || (user_id % 30 + 1), 2, '0')
    WHEN 2 THEN '2023-' || lpad('' || (user_id % 12 + 1), 2, '0') || '-' || (user_id % 9 + 1)
    WHEN 3 THEN (user_id % 9 + 1) || ' months ago'
    ELSE 'Sep ' || (user_id % 28 + 1) || ' 2023 at 10:00' END"""


@query(
    "general_dates",
    f"""WITH t AS (SELECT event_id, user_id, {_GENERAL} AS raw FROM events)
        SELECT event_id, CASE event_id % 5
            WHEN 0 THEN epoch_us(make_timestamp(2024, 1, 30, user_id % 24, 30, 0.0)) + 12345678
            WHEN 1 THEN epoch_us(make_timestamp(2023, 9, user_id % 30 + 1, 0, 0, 0.0) + {_REF_TIME})
            WHEN 2 THEN epoch_us(make_timestamp(2023, user_id % 12 + 1, user_id % 9 + 1, 0, 0, 0.0) + {_REF_TIME})
            WHEN 4 THEN epoch_us(make_timestamp(2023, 9, user_id % 28 + 1, 10, 0, 0.0)) + 12345678 END AS value_us,
          CASE WHEN event_id % 5 = 3 THEN 'unknown' WHEN event_id % 5 IN (2, 4) THEN 'exact' ELSE 'heuristic' END AS confidence,
          CASE WHEN event_id % 5 = 3 THEN 'unparseable:''' || raw || '''' WHEN event_id % 5 IN (2, 4) THEN 'absolute_parsed'
            ELSE 'absolute_parsed_year_inferred_from_reference_time' END AS reason FROM t""",
)
def general_dates(spark, sf):
    return _parsed(table(spark, sf, "events", "event_id user_id"), "event_id", _GENERAL)


@query(
    "unparseable_dates",
    """SELECT event_id, NULL::BIGINT AS value_us, 'unknown' AS confidence,
         'unparseable:' || CASE event_id % 2 WHEN 0 THEN '''' || event_type || ' ' || props || '''' ELSE '"it''s ' || event_type || '"' END AS reason
       FROM events""",
)
def unparseable_dates(spark, sf):
    raw = "CASE event_id % 2 WHEN 0 THEN event_type || ' ' || props ELSE concat('it', chr(39), 's ', event_type) END"
    return _parsed(table(spark, sf, "events", "event_id event_type props"), "event_id", raw)


@query(
    "row_reference_dates",
    """SELECT event_id, epoch_us(ts) - user_id * 3600000000 AS value_us, 'relative_exact' AS confidence,
         'relative:' || user_id || '_hour_ago' AS reason FROM events""",
)
def row_reference_dates(spark, sf):
    """Every row has its own reference, such as the time its response was received."""
    events = table(spark, sf, "events", "event_id user_id ts")
    return _parsed(events, "event_id", "user_id || ' hours ago'", F.col("ts").cast("timestamp"))


@query(
    "freshness_gate",
    f"""SELECT event_id, event_type, value FROM events
        WHERE ts BETWEEN {REF_SQL} - INTERVAL 24 HOUR AND {REF_SQL}""",
)
def freshness_gate(spark, sf):
    """Both bounds of the window are pushed down to the scan."""
    ref = F.lit(REF).cast("timestamp_ntz")
    return table(spark, sf, "events").filter(d.in_window(F.col("ts"), ref)).select("event_id", "event_type", "value")


@query(
    "freshness_flag",
    f"""SELECT o_orderkey, coalesce(d BETWEEN TIMESTAMP '1998-06-15 12:00:00' - INTERVAL 720 HOUR AND TIMESTAMP '1998-06-15 12:00:00', false) AS fresh
        FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS d FROM orders)""",
)
def freshness_flag(spark, sf):
    orders = table(spark, sf, "orders", "o_orderkey o_orderstatus o_orderdate")
    date = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return orders.select("o_orderkey", d.is_fresh(date, F.lit("1998-06-15 12:00:00").cast("timestamp_ntz"), 720).alias("fresh"))


@query(
    "freshness_counts",
    f"""WITH t AS (SELECT user_id * {_UNIT_SECONDS} AS age FROM events)
        SELECT count(*) FILTER (age <= 86400)::BIGINT AS n_fresh, count(*) FILTER (age > 86400)::BIGINT AS n_stale FROM t""",
)
def freshness_count(spark, sf):
    events = table(spark, sf, "events", "event_id user_id").select(F.expr(_AGO).alias("raw"))
    return freshness_counts(events, "raw", _ref())


@query(
    "window_boundary",
    f"""SELECT event_id, n <= 48 AS fresh FROM (SELECT event_id, user_id % 60 AS n FROM events)""",
)
def window_boundary(spark, sf):
    """Rows exactly on the bounds of a 48-hour window are fresh, rows beyond are not."""
    events = table(spark, sf, "events", "event_id user_id")
    value = _ref() - F.make_dt_interval(F.lit(0), (F.col("user_id") % 60).cast("int"))
    return events.select("event_id", d.is_fresh(value, _ref(), 48).alias("fresh"))
