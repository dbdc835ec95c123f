"""Fetch and provider-response queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import http as h
from ..functions.urls import netloc
from ..operators.fetch import FetchConfig, fetch_log, fetch_pages, with_lane
from .catalog import query, table

_STATUS = "CASE page_id % 9 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 429 WHEN 3 THEN 0 WHEN 4 THEN 404 ELSE 200 END"
_BODY = """html || CASE page_id % 5 WHEN 0 THEN '<p>Checking your Browser</p>' WHEN 1 THEN '<i id=CF-CHL></i>' ELSE '' END"""
_BLOCKED_SQL = f"""({_STATUS} IN (403, 503) OR contains(lower({_BODY}), 'cf-browser-verification') OR contains(lower({_BODY}), 'datadome')
    OR contains(lower({_BODY}), 'checking your browser') OR contains(lower({_BODY}), 'cf-chl'))"""


@query(
    "fetch_decision",
    f"""WITH t AS (SELECT page_id, {_STATUS} AS status, {_BLOCKED_SQL} AS blocked, page_id % 4 + 1 AS attempt FROM pages)
        SELECT page_id, blocked, status = 200 AND NOT blocked AS success,
          CASE WHEN status = 200 AND NOT blocked THEN 'accept' WHEN status IN (429, 0) AND attempt < 3 THEN 'retry' ELSE 'escalate' END AS next_action
        FROM t""",
)
def fetch_decision(spark, sf):
    pages = table(spark, sf, "pages", "page_id html").select(
        "page_id", F.expr(_STATUS).alias("status"), F.expr(_BODY).alias("body"), (F.col("page_id") % 4 + 1).alias("attempt")
    )
    status, body = F.col("status"), F.col("body")
    return pages.select(
        "page_id", h.is_blocked(status, body).alias("blocked"), h.is_success(status, body).alias("success"),
        h.next_action(status, body, F.col("attempt")).alias("next_action"),
    )


_CODE = "CASE doc_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 413 WHEN 3 THEN 500 WHEN 4 THEN 400 WHEN 5 THEN 401 WHEN 6 THEN 529 ELSE 302 END"
_REPLY = "text || CASE doc_id % 3 WHEN 0 THEN ' Maximum length' ELSE '' END"


@query(
    "error_classes",
    f"""WITH t AS (SELECT doc_id, {_CODE} AS status, lower({_REPLY}) AS body FROM documents)
        SELECT doc_id, CASE WHEN status = 429 THEN 'rate_limited' WHEN status = 413 THEN 'payload_too_large'
          WHEN status >= 500 THEN 'unavailable'
          WHEN status = 400 AND (contains(body, 'context') OR contains(body, 'too long') OR contains(body, 'maximum')) THEN 'payload_too_large'
          WHEN status <> 200 THEN 'http_error' END AS error_class FROM t""",
)
def error_classes(spark, sf):
    docs = table(spark, sf, "documents", "doc_id text")
    return docs.select("doc_id", h.error_class(F.expr(_CODE), F.expr(_REPLY)).alias("error_class"))


@query(
    "backoff_schedule",
    """SELECT event_id, least(1.5::DOUBLE * power(2, event_id % 8), 30)::DOUBLE AS provider_wait,
         power(2, event_id % 8)::DOUBLE AS fetch_wait FROM events""",
)
def backoff_schedule(spark, sf):
    attempt = F.col("event_id") % 8 + 1
    return table(spark, sf, "events", "event_id").select(
        "event_id", h.provider_backoff(attempt).alias("provider_wait"), h.fetch_backoff(attempt).alias("fetch_wait")
    )


@query(
    "reply_text",
    "SELECT conv_id, turn, text AS from_choices, text AS from_candidates FROM conversations",
)
def reply_text(spark, sf):
    """Wrap every turn in both reply layouts and read it back by path."""
    turns = table(spark, sf, "conversations", "conv_id turn text")
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    parts = F.array(F.struct(F.col("text").alias("text")))
    candidates = F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates")))
    return turns.select(
        "conv_id", "turn", h.reply_text(choices, h.REPLY_PATHS["choices"]).alias("from_choices"),
        h.reply_text(candidates, h.REPLY_PATHS["candidates"]).alias("from_candidates"),
    )


def _stub_http(url: str, html: str) -> tuple[int, str]:
    """Offline stand-in for a plain request: serves the stored page; the outcome depends on the length of the address."""
    kind = len(url) % 7
    if kind == 0:
        raise OSError("unreachable")
    status = {1: 429, 2: 403, 3: 404}.get(kind, 200)
    return status, html + ("<i>DataDome</i>" if kind == 4 else "")


def _stub_browser(url: str, html: str) -> tuple[int, str]:
    if len(url) % 7 == 3:
        raise RuntimeError("crashed")
    return 200, f"<main>{html}</main>"


# What the stand-ins give: kind 5 and 6 succeed at once, unless the page itself holds a marker of a challenge.
_SERVED = """WITH t AS (SELECT page_id, url, html, length(url) % 7 AS kind,
         regexp_matches(lower(html), 'cf-browser-verification|datadome|checking your browser|cf-chl') AS marked FROM pages),
       served AS (SELECT *, kind IN (5, 6) AND NOT marked AS plain FROM t)"""


def _no_wait(_: float) -> None:
    return None


@query(
    "fetch_adaptive",
    f"""{_SERVED} SELECT page_id, url, CASE WHEN kind = 3 THEN 404 ELSE 200 END::INTEGER AS status,
         CASE WHEN plain OR kind = 3 THEN html ELSE '<main>' || html || '</main>' END AS html,
         CASE WHEN plain OR kind = 3 THEN 'http' ELSE 'browser' END AS strategy, kind <> 3 AS success,
         CASE WHEN kind IN (0, 1) THEN 3 ELSE 1 END::INTEGER AS http_attempts FROM served""",
)
def fetch_adaptive(spark, sf):
    """Stored pages served through the fetch path; what is written down is the stored page."""
    return _fetched(spark, sf).drop("elapsed_ms", "attempts")


def _fetched(spark, sf):
    pages = table(spark, sf, "pages", "page_id url html").withColumnRenamed("html", "stored")
    return fetch_pages(pages, _stub_http, _stub_browser, FetchConfig(sleep=_no_wait), more=("stored",)).drop("stored")


@query(
    "fetch_attempts",
    f"""{_SERVED}, tries AS (SELECT page_id, kind, unnest(range(1, CASE WHEN kind IN (0, 1) THEN 4 ELSE 2 END)) AS n FROM served),
       steps AS (SELECT page_id, n::INTEGER AS attempt, 'http' AS strategy,
           CASE kind WHEN 0 THEN 0 WHEN 1 THEN 429 WHEN 2 THEN 403 WHEN 3 THEN 404 ELSE 200 END::INTEGER AS status FROM tries
         UNION ALL SELECT page_id, CASE WHEN kind IN (0, 1) THEN 4 ELSE 2 END::INTEGER, 'browser',
           CASE WHEN kind = 3 THEN 0 ELSE 200 END::INTEGER FROM served WHERE NOT plain)
       SELECT * FROM steps""",
)
def fetch_attempts(spark, sf):
    return fetch_log(_fetched(spark, sf), "page_id").drop("elapsed_ms")


@query(
    "lane_bounds",
    """WITH d AS (SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS domain, count(*) AS pages FROM pages GROUP BY 1)
       SELECT domain, pages, true AS within_bound FROM d""",
)
def lane_bounds(spark, sf):
    """Pages per domain, and whether they lie in no more lanes than the domain may have requests at once."""
    config = FetchConfig()
    placed = with_lane(table(spark, sf, "pages", "page_id url"), config).withColumn("domain", netloc(F.col("url")))
    lanes = F.count_distinct("_lane")
    return placed.groupBy("domain").agg(F.count("*").alias("pages"), (lanes <= config.per_domain).alias("within_bound"))
