"""Output-table, sink, tracking, graph and streaming queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..functions.urls import netloc
from ..operators import graph, observe
from ..session import Workspace
from ..sinks import files
from ..sinks.commit import TableSet
from ..streaming import gates
from . import outputs as out
from .catalog import query, table
from .resolve_queries import NAMES_SQL, PART_NAME, SEEDS_SQL, part_names, part_seeds, resolution_sql

_REF = datetime(1998, 6, 15, 12, 30, 15, 250_000)
_REF_SQL = "TIMESTAMP '1998-06-15 12:30:15.25'"
_AT_TEXT = "'1998-06-15T12:30:15.250000+00:00'"
_SITE = "https://example.com/companies/"


def _at():
    return F.lit(_REF).cast("timestamp")


def _startups(spark, sf):
    """Parts as startup rows, in key order."""
    return part_names(spark, sf).join(table(spark, sf, "part"), F.col("ord") == F.col("p_partkey")).select(
        F.col("ord").alias("ordinal"), F.col("raw").alias("entityName"), F.col("p_size").alias("employeeCount"),
        F.col("p_type").alias("description"), F.concat(F.lit(_SITE), "p_partkey").alias("source_url"),
    )


_JOB_NAME = "CASE o_orderkey % 4 WHEN 0 THEN 'blue ring' WHEN 1 THEN upper('cold bolt') || ' GmbH' WHEN 2 THEN 'Hiring ' || o_orderpriority ELSE 'hot gearr' END"
_JOB_DATE = "CASE o_orderkey % 3 WHEN 0 THEN {date} WHEN 1 THEN (o_custkey % 60) || ' hours ago' ELSE NULL END"


def _jobs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ordinal"), F.expr(_JOB_NAME).alias("company"), F.col("o_orderpriority").alias("title"),
        F.lit("Board").alias("source_name"), F.concat(F.lit("https://jobs.example.com/"), "o_orderkey").alias("source_url"),
        F.expr(_JOB_DATE.format(date="date_format(o_orderdate, 'yyyy-MM-dd')")).alias("date"),
        F.expr("CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END").alias("is_remote"),
        F.lit("Engineering").alias("role_family"),
    )


def _papers(spark, sf):
    docs = table(spark, sf, "documents", "doc_id lang source n_chars")
    raw = docs.select(
        F.concat_ws(" ", "lang", "source").alias("title"),
        F.concat(F.lit("https://arxiv.org/abs/2401."), "doc_id").alias("paper_url"),
        F.concat(F.lit("https://github.com/"), "source", F.lit("/"), "doc_id").alias("github_url"),
        F.col("n_chars").alias("github_stars"),
        F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source")).alias("authors"),
    )
    return out.with_paper_defaults(raw, "Daily papers", "https://example.com/papers")


def _news(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("title"), F.lit("Wire").alias("source_name"),
        F.concat(F.lit("https://news.example.com/"), "event_id").alias("source_url"),
        F.expr("(user_id % 40) || ' hours ago'").alias("published_date"), F.col("props").alias("content_excerpt"),
    )


def _build(spark, sf):
    return out.build_tables(
        _startups(spark, sf), _papers(spark, sf), _jobs(spark, sf), _news(spark, sf), part_seeds(spark, sf), _REF, "Directory"
    )


_FRESH_JOBS = f"""SELECT *, {_JOB_NAME} AS company, {_JOB_DATE.format(date="strftime(o_orderdate, '%Y-%m-%d')")} AS date FROM orders
    WHERE CASE o_orderkey % 3
      WHEN 0 THEN date_trunc('day', o_orderdate) + ({_REF_SQL} - date_trunc('day', {_REF_SQL})) BETWEEN {_REF_SQL} - INTERVAL 24 HOUR AND {_REF_SQL}
      WHEN 1 THEN o_custkey % 60 <= 24 ELSE false END"""
_BATCH_NAMES = f"""SELECT ord, raw FROM ({NAMES_SQL}) UNION ALL
    SELECT o_orderkey + 72057594037927936, company FROM ({_FRESH_JOBS})"""
_ENVELOPE = "'1.0' AS \"schemaVersion\", '{0}' AS \"recordType\", {1} AS \"source.name\", {2} AS \"source.url\""


@query(
    "build_startups",
    resolution_sql(
        _BATCH_NAMES, SEEDS_SQL,
        f"""SELECT {_ENVELOPE.format("STARTUP", "'Directory'", f"'{_SITE}' || p_partkey")}, canonical_name AS "content.entityName",
            p_size AS "content.data.employeeCount", {_AT_TEXT} AS "collectedAt" FROM resolved JOIN part ON p_partkey = ord""",
    ),
)
def build_startups(spark, sf):
    return _build(spark, sf)["startups"]


@query(
    "build_products",
    resolution_sql(
        _BATCH_NAMES, SEEDS_SQL,
        f"""SELECT {_ENVELOPE.format("PRODUCT", "'Directory'", f"'{_SITE}' || p_partkey")}, canonical_name AS "content.startupName",
            '' AS "content.pricingModel", p_type AS "content.description", {_AT_TEXT} AS "collectedAt" FROM resolved JOIN part ON p_partkey = ord""",
    ),
)
def build_products(spark, sf):
    return _build(spark, sf)["products"]


@query(
    "build_jobs",
    resolution_sql(
        _BATCH_NAMES, SEEDS_SQL,
        f"""SELECT {_ENVELOPE.format("JOB", "'Board'", "'https://jobs.example.com/' || o_orderkey")}, canonical_name AS "content.company",
            o_orderpriority AS "content.title", date AS "content.date", CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS "content.is_remote",
            'Engineering' AS "content.role_family", {_AT_TEXT} AS "collectedAt"
            FROM resolved JOIN ({_FRESH_JOBS}) ON o_orderkey + 72057594037927936 = ord""",
    ),
)
def build_jobs(spark, sf):
    return _build(spark, sf)["jobs"]


@query(
    "build_mapping_log",
    resolution_sql(
        _BATCH_NAMES, SEEDS_SQL,
        "SELECT raw AS raw_name, canonical_name, method, round_even(confidence, 3)::DOUBLE AS confidence FROM resolved",
    ),
)
def build_mapping_log(spark, sf):
    return _build(spark, sf)["entity_mapping_log"]


_PAPERS_SQL = f"""SELECT {_ENVELOPE.format("RESEARCH_PAPER", "'Daily papers'", "'https://arxiv.org/abs/2401.' || doc_id")},
    lang || ' ' || source AS "content.title", CASE WHEN doc_id % 3 = 0 THEN lang || ', ' || source ELSE '' END AS "content.authors",
    'https://arxiv.org/abs/2401.' || doc_id AS "content.paper_url", 'https://github.com/' || source || '/' || doc_id AS "content.github_url",
    n_chars AS "content.github_stars", '2024-01-01T00:00:00' AS "content.published_date", {_AT_TEXT} AS "collectedAt" FROM documents"""


@query("papers_table", _PAPERS_SQL)
def papers_table(spark, sf):
    return out.papers_table(_papers(spark, sf), _at())


@query(
    "news_table",
    f"""SELECT {_ENVELOPE.format("NEWS", "'Wire'", "'https://news.example.com/' || event_id")}, event_type AS "content.title",
        (user_id % 40) || ' hours ago' AS "content.published_date", props AS "content.excerpt", {_AT_TEXT} AS "collectedAt"
        FROM events WHERE user_id % 40 <= 24""",
)
def news_table(spark, sf):
    return out.news_table(out.fresh_only(_news(spark, sf), "published_date", _at()), _at())


@query(
    "jobs_gate_counts",
    f"""SELECT count(*)::BIGINT AS n_fresh, ((SELECT count(*) FROM orders) - count(*))::BIGINT AS n_stale FROM ({_FRESH_JOBS})""",
)
def jobs_gate_counts(spark, sf):
    return out.freshness_counts(_jobs(spark, sf), "date", _at())


@query(
    "flatten_entities",
    """SELECT '1.0' AS "schemaVersion", 'STARTUP' AS "recordType", 'Registry' AS "source.name", 'https://example.com/' || s_suppkey AS "source.url",
         s_name AS "content.entityName", s_nationkey AS "content.data.employeeCount" FROM supplier""",
)
def flatten_entities(spark, sf):
    nested = table(spark, sf, "supplier").select(
        F.lit("1.0").alias("schemaVersion"), F.lit("STARTUP").alias("recordType"),
        F.struct(F.lit("Registry").alias("name"), F.concat(F.lit("https://example.com/"), "s_suppkey").alias("url")).alias("source"),
        F.struct(F.col("s_name").alias("entityName"), F.struct(F.col("s_nationkey").alias("employeeCount")).alias("data")).alias("content"),
    )
    return out.flatten(nested)


@query("csv_round_trip", _PAPERS_SQL.replace("n_chars AS", "'' || n_chars AS").replace("ELSE '' END", "ELSE NULL END"))
def csv_round_trip(spark, sf):
    """Write the paper table as CSV and read it back; empty and null are one in CSV."""
    path = Workspace(spark).path("papers-csv")
    files.write_table(papers_table(spark, sf), path, "research_papers")
    return files.read_table(spark, path)


@query("published_papers", _PAPERS_SQL)
def published_papers(spark, sf):
    """Papers and news published as one version, and once more; the papers of the version in force."""
    store = TableSet(spark, Workspace(spark).path("published"))
    for _ in range(2):
        store.publish({"research_papers": papers_table(spark, sf), "news": news_table(spark, sf)})
    return store.read()["research_papers"]


@query(
    "rows_per_file",
    "SELECT count(*)::BIGINT AS n_rows FROM documents",
)
def rows_per_file(spark, sf):
    """Documents as CSV files, counted file by file; how many files there are is up to the layout."""
    path = Workspace(spark).path("csv-files")
    table(spark, sf, "documents", "doc_id lang source").write.option("header", True).csv(path)
    return files.rows_per_file(files.read_table(spark, path)).agg(F.sum("n_rows").alias("n_rows"))


@query(
    "json_preview",
    """SELECT substr('{' || chr(10) || '  "doc_id" : ' || doc_id || ',' || chr(10) || '  "lang" : "' || lang || '",' || chr(10)
         || '  "source" : "' || source || '"' || chr(10) || '}', 1, 40) AS preview FROM documents""",
)
def json_preview(spark, sf):
    return files.json_preview(table(spark, sf, "documents", "doc_id lang source"), n_chars=40)


# --- tracking, graph, second opinion: described by the reference in prose only ------


@query(
    "first_seen_articles",
    """SELECT source, h, doc_id AS first_doc FROM (
         SELECT source, md5(text) AS h, doc_id, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""",
)
def first_seen_articles(spark, sf):
    docs = table(spark, sf, "documents", "doc_id source text").select("source", F.md5("text").alias("h"), F.col("doc_id").alias("first_doc"))
    return observe.first_seen(docs, ["source", "h"], "first_doc")


@query(
    "unseen_pages",
    """SELECT domain, min(page_id) AS page_id FROM (
         SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain, page_id, html FROM pages)
       WHERE domain NOT IN (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) FROM pages WHERE html LIKE '%lang="de"%')
       GROUP BY domain""",
)
def unseen_pages(spark, sf):
    pages = table(spark, sf, "pages").select(netloc(F.col("url")).alias("domain"), "page_id", "html")
    seen = pages.filter(F.contains("html", F.lit('lang="de"'))).select("domain").distinct()
    return observe.unseen(pages.select("domain", "page_id"), seen, ["domain"], "page_id")


@query(
    "content_changes",
    """WITH t AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
       SELECT user_id, min(event_id) AS first_seen,
         coalesce(max(event_id) FILTER (prev IS NOT NULL AND prev <> event_type), min(event_id)) AS updated_at,
         arg_max(event_type, event_id) AS content, count(DISTINCT event_type)::BIGINT AS n_versions FROM t GROUP BY user_id""",
)
def content_changes(spark, sf):
    events = table(spark, sf, "events", "user_id event_id event_type")
    return observe.track_changes(events, "user_id", "event_type", "event_id").withColumnRenamed("content_hash", "content")


@query(
    "graph_two_hop",
    """SELECT DISTINCT r.r_name AS start, 'C' || c.c_custkey AS node FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey
       JOIN customer c ON c.c_nationkey = n.n_nationkey""",
)
def graph_two_hop(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    in_region = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("src"), F.lit("HOLDS").alias("relation"), F.concat(F.lit("N"), "n_nationkey").alias("dst")
    )
    in_nation = table(spark, sf, "customer").select(
        F.concat(F.lit("N"), "c_nationkey").alias("src"), F.lit("HOME_OF").alias("relation"), F.concat(F.lit("C"), "c_custkey").alias("dst")
    )
    starts = region.select(F.col("r_name").alias("node"))
    return graph.follow(in_region.unionByName(in_nation), starts, ["HOLDS", "HOME_OF"])


@query(
    "startup_edges",
    resolution_sql(
        _BATCH_NAMES, SEEDS_SQL,
        f"""SELECT canonical_name AS src, 'BUILDS' AS relation, '{_SITE}' || ord AS dst FROM resolved WHERE ord < 72057594037927936
            UNION ALL SELECT canonical_name, 'EMPLOYS_VIA', 'https://jobs.example.com/' || (ord - 72057594037927936) FROM resolved WHERE ord >= 72057594037927936""",
    ),
)
def startup_edges(spark, sf):
    tables = _build(spark, sf)
    return graph.builds_edges(tables["products"]).unionByName(graph.employs_edges(tables["jobs"]))


@query(
    "second_opinion",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)::DOUBLE AS similarity
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def second_opinion(spark, sf):
    """Cosine of given candidate pairs; candidates come from elsewhere, never from all pairs."""
    a = table(spark, sf, "embeddings", "vec_id embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 9).alias("similarity"))


# --- streaming -------------------------------------------------------------------


def _stream(spark, sf, name: str):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query(
    "stream_fresh",
    """SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-30 18:00:00' - INTERVAL 24 HOUR AND TIMESTAMP '2024-01-30 18:00:00'""",
)
def stream_fresh(spark, sf):
    work = Workspace(spark)
    ref = F.lit("2024-01-30 18:00:00").cast("timestamp_ntz")
    fresh = gates.stream_fresh(_stream(spark, sf, "events"), F.col("ts"), ref).select("event_id", "event_type")
    path = work.path("fresh")
    gates.drain(fresh, path, work.path("fresh-checkpoint"))
    return spark.read.schema(fresh.schema).parquet(path)


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf):
    work = Workspace(spark)
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = gates.stream_first_seen(events, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")
    path = work.path("first")
    gates.drain(first, path, work.path("first-checkpoint"))
    return spark.read.schema(first.schema).parquet(path)


@query(
    "stream_resolve",
    resolution_sql(NAMES_SQL, SEEDS_SQL, "SELECT ord, canonical_name, method, confidence FROM resolved"),
)
def stream_resolve(spark, sf):
    work = Workspace(spark)
    names = _stream(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.expr(PART_NAME).alias("raw"))
    sink = gates.ResolvingSink(part_seeds(spark, sf), "raw", "ord", work.path("sink"))
    gates.drain_batches(names, sink, work.path("sink-checkpoint"))
    return sink.resolved().select("ord", "canonical_name", "method", "confidence")
