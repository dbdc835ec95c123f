"""Fetch and provider response predicates, and retry delays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Body texts of bot-challenge pages, and statuses of a refusal.
CHALLENGE_MARKERS = ("cf-browser-verification", "datadome", "checking your browser", "cf-chl")
BLOCK_STATUSES = (403, 503)
# Words by which a 400 reply reports an oversized request.
OVERSIZE_WORDS = ("context", "too long", "maximum")


def _contains_any(body: Column, words: tuple[str, ...]) -> Column:
    lowered = F.lower(F.coalesce(body, F.lit("")))
    found = F.lit(False)
    for word in words:
        found = found | F.contains(lowered, F.lit(word))
    return found


def is_blocked(status: Column, body: Column) -> Column:
    return status.isin(*BLOCK_STATUSES) | _contains_any(body, CHALLENGE_MARKERS)


def is_success(status: Column, body: Column, strategy: str = "http") -> Column:
    """A browser result needs status 200; a plain one must not be a challenge page either."""
    ok = status == 200
    return ok if strategy == "browser" else ok & ~is_blocked(status, body)


def next_action(status: Column, body: Column, attempt: Column, max_retries: int = 3) -> Column:
    """``accept``, ``retry`` or ``escalate`` after attempt number ``attempt`` (from 1)."""
    retryable = status.isin(429, 0) & (attempt < max_retries)
    return (
        F.when(is_success(status, body), "accept").when(retryable, "retry").otherwise("escalate")
    )


def error_class(status: Column, body: Column) -> Column:
    """Provider reply class; null for a good reply."""
    oversized = (status == 413) | ((status == 400) & _contains_any(body, OVERSIZE_WORDS))
    return (
        F.when(status == 429, "rate_limited")
        .when(oversized, "payload_too_large")
        .when(status >= 500, "unavailable")
        .when((status < 200) | (status >= 300), "http_error")
    )


def provider_backoff(attempt: Column, base: float = 1.5, cap: float = 30.0) -> Column:
    """Seconds before jitter: doubled per attempt, capped."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(cap)))


def fetch_backoff(attempt: Column, base: float = 1.0) -> Column:
    """Seconds before jitter: doubled per attempt, not capped."""
    return F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1)


def reply_text(reply: Column, path: str) -> Column:
    """Text of a provider reply at a JSON path."""
    return F.get_json_object(reply, path)


# Where the two reply layouts keep their text.
REPLY_PATHS = {
    "candidates": "$.candidates[0].content.parts[0].text",
    "choices": "$.choices[0].message.content",
}
