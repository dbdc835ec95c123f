"""Reply validation, extraction and envelope queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import records as r
from ..functions.prompts import TEXT_CLOSE, TEXT_OPEN, INSTRUCTIONS, extraction_prompt
from ..operators import extract as ex
from ..sources.providers import PayloadTooLarge, Provider, RateLimited, TransportError, Unavailable
from .catalog import query, table
from .text_queries import packing_sql


def _variants(key: str, values: list[str | None]) -> str:
    """A CASE that deals JSON fragments to rows; None leaves the member out."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"(CASE {key} % {len(values)} {cases} END)"


def _member(name: str, fragment: str) -> str:
    return f"coalesce(', \"{name}\": ' || {fragment}, '')"


def _picked(key: str, values: list) -> str:
    """The SQL literal a row's variant should lead to."""

    def literal(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)

    cases = " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values) if v is not None)
    return f"(CASE {key} % {len(values)} {cases} END)"


def _judged(df, key: str, payload: str, record_type: str, fields: dict[str, str]):
    """Key, reject, errors and the wanted content members of a payload expression."""
    verdict = r.validate_reply(F.expr(payload), F.lit(record_type), (record_type,))
    rows = df.select(key, verdict.alias("v")).select(
        key, "v.reject", F.array_join("v.errors", ",").alias("errors"),
        r.typed_content(F.col("v.content"), record_type).alias("c"),
    )
    return rows.select(key, "reject", "errors", *[F.col(f"c.{path}").alias(name) for name, path in fields.items()])


# Raw JSON of employeeCount and the count it stands for ("bad" marks a rejection).
_COUNTS = [
    ("10", 10), ('"10"', 10), ('" 12 "', 12), ('"12.0"', 12), ('"12."', "bad"), ('"1,500"', "bad"), ("10.5", "bad"), ("10.0", 10),
    ("true", 1), ("null", None), (None, None), ('"1_000"', 1000), ("[1]", "bad"), ('"ten"', "bad"), ("-3", -3),
]
_COUNT_JSON = _variants("s_suppkey", [j for j, _ in _COUNTS])
_COUNT_BAD = _picked("s_suppkey", [True if v == "bad" else False for _, v in _COUNTS])
_COUNT_VALUE = _picked("s_suppkey", [None if v == "bad" else v for _, v in _COUNTS])
_STARTUP = f"""'{{"entityName": "' || s_name || '", "extra": 1, "data": {{"other": 2' || {_member("employeeCount", _COUNT_JSON)} || '}}}}'"""


@query(
    "validate_startups",
    f"""SELECT s_suppkey, CASE WHEN {_COUNT_BAD} THEN 'schema' END AS reject,
        CASE WHEN {_COUNT_BAD} THEN 'data.employeeCount:type' END AS errors,
        CASE WHEN NOT {_COUNT_BAD} THEN s_name END AS entity_name, ({_COUNT_VALUE})::BIGINT AS employee_count FROM supplier""",
)
def validate_startups(spark, sf):
    return _judged(
        table(spark, sf, "supplier"), "s_suppkey", _STARTUP, "STARTUP",
        {"entity_name": "entityName", "employee_count": "data.employeeCount"},
    )


_PRICES = [('"FREE"', "FREE"), ('"free"', "bad"), ('"PAID"', "PAID"), ("null", None), ('""', "bad"), (None, None), ("3", "bad"), ('"ENTERPRISE"', "ENTERPRISE")]
_PRICE_BAD = _picked("p_partkey", [v == "bad" for _, v in _PRICES])
_PRODUCT = f"""'{{"startupName": "' || p_name || '"' || {_member("pricingModel", _variants("p_partkey", [j for j, _ in _PRICES]))} || '}}'"""


@query(
    "validate_products",
    f"""SELECT p_partkey, CASE WHEN {_PRICE_BAD} THEN 'schema' END AS reject, CASE WHEN {_PRICE_BAD} THEN 'pricingModel:value' END AS errors,
        CASE WHEN NOT {_PRICE_BAD} THEN p_name END AS startup_name, {_picked("p_partkey", [None if v == "bad" else v for _, v in _PRICES])} AS pricing_model
        FROM part""",
)
def validate_products(spark, sf):
    return _judged(
        table(spark, sf, "part"), "p_partkey", _PRODUCT, "PRODUCT", {"startup_name": "startupName", "pricing_model": "pricingModel"}
    )


_REMOTE = [("true", True), ('"yes"', True), ('"No"', False), ("1", True), ("2", "bad"), ('"maybe"', "bad"), ("null", None), (None, None), ("0.0", False), ('"off"', False)]
_DATES = [
    ('"2024-03-05"', "2024-03-05T00:00:00"), ('"2024-03-05T10:20"', "2024-03-05T10:20:00"), ('"Mar 5"', "bad"),
    ('"2024-03-05T10:20:30.5Z"', "2024-03-05T10:20:30.500000Z"), ("1709600000", "2024-03-05T00:53:20Z"), (None, None),
    ('"2024-02-30"', "bad"), ('"2024-03-05 10:20:30+0530"', "2024-03-05T10:20:30+05:30"), ("false", "bad"), ('"1709600000000"', "2024-03-05T00:53:20Z"),
    ("null", None),
]
_REMOTE_BAD, _DATE_BAD = _picked("o_orderkey", [v == "bad" for _, v in _REMOTE]), _picked("o_custkey", [v == "bad" for _, v in _DATES])
_JOB = f"""'{{"company": "C' || o_custkey || '", "role_family": "' || o_orderpriority || '"'
    || {_member("is_remote", _variants("o_orderkey", [j for j, _ in _REMOTE]))} || {_member("date", _variants("o_custkey", [j for j, _ in _DATES]))} || '}}'"""


@query(
    "validate_jobs",
    f"""WITH t AS (SELECT *, {_REMOTE_BAD} AS rb, {_DATE_BAD} AS db, {_picked("o_orderkey", [None if v == "bad" else v for _, v in _REMOTE])} AS remote,
          {_picked("o_custkey", [None if v == "bad" else v for _, v in _DATES])} AS d FROM orders)
        SELECT o_orderkey, CASE WHEN rb OR db THEN 'schema' END AS reject,
          CASE WHEN rb AND db THEN 'date:type,is_remote:type' WHEN rb THEN 'is_remote:type' WHEN db THEN 'date:type' END AS errors,
          CASE WHEN NOT (rb OR db) THEN 'C' || o_custkey END AS company, CASE WHEN NOT (rb OR db) THEN d END AS date,
          CASE WHEN NOT (rb OR db) THEN remote END AS is_remote, CASE WHEN NOT (rb OR db) THEN o_orderpriority END AS role_family FROM t""",
)
def validate_jobs(spark, sf):
    return _judged(
        table(spark, sf, "orders"), "o_orderkey", _JOB, "JOB",
        {"company": "company", "date": "date", "is_remote": "is_remote", "role_family": "role_family"},
    )


_AUTHORS = [('["A", "B"]', "A, B"), ("[]", ""), (None, ""), ("null", "bad"), ('["A", 1]', "bad"), ('"A"', "bad")]
_AUTHORS_BAD = _picked("doc_id", [v == "bad" for _, v in _AUTHORS])
_TITLE = "(lang || ' ' || source)"
_PAPER = f"""'{{"paper_url": "https://arxiv.org/abs/' || doc_id || '", "github_stars": ' || n_chars || CASE WHEN doc_id % 4 <> 3 THEN ', "title": "' || {_TITLE} || '"' ELSE '' END
    || {_member("authors", _variants("doc_id", [j for j, _ in _AUTHORS]))} || '}}'"""


@query(
    "validate_papers",
    f"""WITH t AS (SELECT *, doc_id % 4 = 3 AS tb, {_AUTHORS_BAD} AS ab FROM documents)
        SELECT doc_id, CASE WHEN tb OR ab THEN 'schema' END AS reject,
          CASE WHEN tb AND ab THEN 'title:missing,authors:type' WHEN tb THEN 'title:missing' WHEN ab THEN 'authors:type' END AS errors,
          CASE WHEN NOT (tb OR ab) THEN {_TITLE} END AS title, CASE WHEN NOT (tb OR ab) THEN n_chars END AS github_stars,
          CASE WHEN NOT (tb OR ab) THEN {_picked("doc_id", [None if v == "bad" else v for _, v in _AUTHORS])} END AS authors FROM t""",
)
def validate_papers(spark, sf):
    docs = table(spark, sf, "documents", "doc_id lang source n_chars")
    rows = _judged(docs, "doc_id", _PAPER, "RESEARCH_PAPER", {"title": "title", "github_stars": "github_stars", "authors": "authors"})
    return rows.withColumn("authors", F.array_join("authors", ", "))


@query(
    "validate_news",
    """SELECT conv_id, turn, NULL::VARCHAR AS reject, NULL::VARCHAR AS errors, role AS title, text AS excerpt FROM conversations""",
)
def validate_news(spark, sf):
    """Whole texts travel through JSON and back unchanged."""
    turns = table(spark, sf, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    payload = F.to_json(F.struct(F.col("role").alias("title"), F.col("text").alias("excerpt")))
    rows = _judged(turns.withColumn("payload", payload), "key", "payload", "NEWS", {"title": "title", "excerpt": "excerpt"})
    return rows.select("key.*", "reject", "errors", "title", "excerpt")


_REPLIES = ['{"title": "t"}', "{broken", "[1, 2]", '{"__skip__": true}', '{"__skip__": "false"}', '{"__skip__": 0, "title": "t"}', '{"__skip__": null, "title": "t"}', '{"__skip__": []}', "7", '{"__skip__": {"a": 1}}', ""]
_REJECTS = [None, "invalid_json", "invalid_json", "no_entity", "no_entity", None, None, "schema", "invalid_json", "no_entity", "invalid_json"]


@query("reject_reasons", f"SELECT event_id, {_picked('event_id', _REJECTS)} AS reject FROM events")
def reject_reasons(spark, sf):
    verdict = r.validate_reply(F.expr(_variants("event_id", _REPLIES)), F.lit("NEWS"), ("NEWS",))
    return table(spark, sf, "events", "event_id").select("event_id", verdict["reject"].alias("reject"))


@query(
    "event_props",
    "SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events",
)
def event_props(spark, sf):
    """Typed read of a JSON member, type checked before the cast."""
    events = table(spark, sf, "events", "event_id props")
    return events.select("event_id", r.member_as_int(r.parse_reply(F.col("props")), "k").alias("k"))


# --- extraction with offline stand-ins for providers -------------------------------

_LIMIT, _TOKENS = 700, 500


def _text_of(prompt: str) -> str:
    return prompt.split(TEXT_OPEN, 1)[1].rsplit(TEXT_CLOSE, 1)[0]


def _first_tier(prompt: str) -> str:
    text = _text_of(prompt)
    n, kind = len(text), text.count("e") % 6
    if n > _LIMIT:
        raise PayloadTooLarge("stub")
    if kind == 0:
        raise RateLimited("stub")
    if kind == 1:
        raise Unavailable("stub")
    return {2: "{broken", 3: '{"__skip__": true}'}.get(kind, json.dumps({"title": f"first {n}"}))


def _second_tier(prompt: str) -> str:
    text = _text_of(prompt)
    n, kind = len(text), text.count("e") % 5
    if kind == 0:
        raise TransportError("stub")
    return "[]" if kind == 1 else json.dumps({"title": f"second {n}", "other": 1})


def _no_wait(_: float) -> None:
    return None


_PROVIDERS = [Provider("first", _first_tier), Provider("absent", _first_tier, "MILLRACE_ABSENT_KEY"), Provider("second", _second_tier)]

_LEAVES = (
    packing_sql("doc_id", "text", "documents", _TOKENS * 4)
    + f""", halves(doc_id, chunk_index, path, depth, t) AS (
        SELECT doc_id, chunk_index, []::INTEGER[], 0, chunk_text FROM chunks
        UNION ALL
        SELECT doc_id, chunk_index, list_append(path, h), depth + 1,
          CASE h WHEN 0 THEN substring(t, 1, length(t) // 2) ELSE substring(t, length(t) // 2 + 1) END
        FROM (SELECT *, unnest([0, 1]) AS h FROM halves WHERE length(t) > {_LIMIT} AND depth < 3)),
      leaves AS (SELECT doc_id, chunk_index, path, length(t) AS n, length(t) - length(replace(t, 'e', '')) AS e,
                   length(t) > {_LIMIT} AS too_large FROM halves
                 WHERE length(t) <= {_LIMIT} OR depth = 3),
      tried AS (SELECT *, CASE WHEN too_large THEN NULL WHEN e % 6 > 3 THEN 'first' WHEN e % 5 > 1 THEN 'second' END AS provider FROM leaves),
      picked AS (SELECT doc_id, chunk_index, arg_min({{'path': path, 'n': n, 'provider': provider, 'too_large': too_large}},
                   {{'failed': provider IS NULL, 'path': path}}) AS o FROM tried GROUP BY doc_id, chunk_index)
    """
)


def _extraction(spark, sf):
    docs = table(spark, sf, "documents", "doc_id text source").select(
        "doc_id", F.lit("NEWS").alias("record_type"), F.col("text").alias("raw_text"), F.col("source").alias("source_name"),
        F.concat(F.lit("https://example.com/"), "doc_id").alias("source_url"),
        F.lit("2024-01-30 12:00:00").cast("timestamp").alias("reference_time"),
    )
    config = ex.ExtractionConfig(max_tokens_per_chunk=_TOKENS, sleep=_no_wait)
    return ex.extract(docs, _PROVIDERS, config, ("NEWS",))


@query(
    "extract_outcomes",
    _LEAVES
    + """SELECT doc_id, chunk_index::INTEGER AS chunk_index, CASE WHEN o.provider IS NULL THEN 'failure' ELSE 'entity' END AS status,
           o.provider AS provider, CASE WHEN o.too_large THEN 'oversized_after_max_splits' WHEN o.provider IS NULL THEN 'all_providers_exhausted_or_unconfigured' END AS reason,
           CASE WHEN o.provider IS NOT NULL THEN o.provider || ' ' || o.n END AS title FROM picked""",
)
def extract_outcomes(spark, sf):
    outcomes = _extraction(spark, sf).outcomes
    last_provider = F.when(F.col("status") == ex.ENTITY, F.col("provider"))
    return outcomes.select(
        "doc_id", "chunk_index", "status", last_provider.alias("provider"), "reason",
        r.typed_content(F.col("content"), "NEWS")["title"].alias("title"),
    )


@query(
    "extract_entities",
    _LEAVES
    + """SELECT doc_id, chunk_index::INTEGER AS chunk_index, '1.0' AS schema_version, 'NEWS' AS record_type,
           (SELECT any_value(d.source) FROM documents d WHERE d.doc_id = picked.doc_id) AS source_name,
           'https://example.com/' || doc_id AS source_url, o.provider || ' ' || o.n AS title
         FROM picked WHERE o.provider IS NOT NULL""",
)
def extract_entities(spark, sf):
    return _extraction(spark, sf).entities("NEWS").select(
        "doc_id", "chunk_index", F.col("schemaVersion").alias("schema_version"), F.col("recordType").alias("record_type"),
        F.col("source.name").alias("source_name"), F.col("source.url").alias("source_url"), F.col("content.title").alias("title"),
    )


@query(
    "dead_letters",
    _LEAVES
    + """SELECT doc_id, 'https://example.com/' || doc_id AS source_url,
           list_reduce(list_prepend(chunk_index, list_transform(o.path, lambda x: x::BIGINT)), lambda a, x: a * 10 + x)::BIGINT AS chunk_index,
           CASE WHEN o.too_large THEN 'oversized_after_max_splits' ELSE 'all_providers_exhausted_or_unconfigured' END AS reason
         FROM picked WHERE o.provider IS NULL""",
)
def dead_letters(spark, sf):
    return _extraction(spark, sf).failures().select("doc_id", "source_url", "chunk_index", "reason")


@query(
    "extract_attempts",
    _LEAVES
    + f""", calls AS (
        SELECT 'first' AS provider, 'payload_too_large' AS outcome, 1 AS n FROM halves WHERE length(t) > {_LIMIT}
        UNION ALL SELECT 'first', CASE e % 6 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'unavailable' ELSE 'ok' END, CASE e % 6 WHEN 0 THEN 3 ELSE 1 END
          FROM leaves WHERE NOT too_large
        UNION ALL SELECT 'second', CASE e % 5 WHEN 0 THEN 'http_error' ELSE 'ok' END, CASE e % 5 WHEN 0 THEN 3 ELSE 1 END
          FROM leaves WHERE NOT too_large AND e % 6 < 4)
      SELECT provider, outcome, sum(n)::BIGINT AS n_calls FROM calls GROUP BY provider, outcome""",
)
def extract_attempts(spark, sf):
    return _extraction(spark, sf).attempts.groupBy("provider", "outcome").agg(F.count("*").alias("n_calls"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# What a provider is told about a job, written out.
_JOB_SCHEMA = """{"title": "JobContent", "type": "object", "properties": {"company": {"type": "string"}, \
"date": {"anyOf": [{"type": "string", "format": "date-time"}, {"type": "null"}], "default": null}, \
"is_remote": {"anyOf": [{"type": "boolean"}, {"type": "null"}], "default": null}, \
"role_family": {"anyOf": [{"type": "string"}, {"type": "null"}], "default": null}}, "required": ["company"]}"""


@query(
    "extraction_prompt",
    f"""SELECT doc_id, {_quoted(INSTRUCTIONS)} || chr(10) || 'Record type: JOB' || chr(10) || 'Reference time: 2024-01-30T12:00:00.000000+00:00'
        || chr(10) || 'Source: ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END || chr(10) || 'Schema: '
        || {_quoted(_JOB_SCHEMA)} || chr(10) || {_quoted(TEXT_OPEN.strip())} || chr(10) || text || chr(10) || {_quoted(TEXT_CLOSE.strip())} AS prompt
        FROM documents""",
)
def prompts(spark, sf):
    docs = table(spark, sf, "documents", "doc_id text source")
    hint = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    at = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return docs.select("doc_id", extraction_prompt(F.lit("JOB"), F.col("text"), at, hint).alias("prompt"))
