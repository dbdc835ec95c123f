"""Text and URL queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u
from ..operators.chunking import chunk_documents
from ..operators.fetch import enrich_stars, look_up_stars
from ..session import Workspace
from .catalog import query, table

_STRIP = r"regexp_replace({0}, '^[\s\x1c-\x1f\p{{Z}}]+|[\s\x1c-\x1f\p{{Z}}]+$', '', 'g')"


def strip_sql(x: str) -> str:
    return _STRIP.format(x)


def boilerplate_sql(x: str) -> str:
    for pattern, flags in (("<script.*?</script>", "gis"), ("<style.*?</style>", "gis"), ("<!--.*?-->", "gs")):
        x = f"regexp_replace({x}, '{pattern}', ' ', '{flags}')"
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip_sql(x)


def packing_sql(key: str, raw: str, source: str, max_chars: int) -> str:
    """Greedy packing paragraph by paragraph; ends in CTE ``chunks(key, chunk_index, total_chunks, chunk_text)``."""
    return rf"""
    WITH RECURSIVE cleaned AS (SELECT {key} AS k, {boilerplate_sql(raw)} AS t FROM {source}),
    parts AS (
      SELECT k, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda p: {strip_sql('p')}), lambda p: p <> '') AS ps
      FROM cleaned),
    pieces AS (
      SELECT k, unnest(range(1, len(ps) + 1)) AS i, ps FROM parts),
    paras AS (SELECT k, i, ps[i] AS p FROM pieces),
    pack(k, i, open_, n, n_before, is_slice, p) AS (
      -- n counts chunks started so far; the chunk a paragraph falls in decides its number
      SELECT k, 1::BIGINT, length(p)::BIGINT, ceil(length(p) / {max_chars}.0)::BIGINT, 1::BIGINT, length(p) > {max_chars}, p
      FROM paras WHERE i = 1
      UNION ALL
      SELECT q.k, q.i,
        CASE WHEN length(q.p) > {max_chars} THEN 0
             WHEN w.is_slice OR w.open_ + 2 + length(q.p) > {max_chars} THEN length(q.p)
             ELSE w.open_ + 2 + length(q.p) END,
        CASE WHEN length(q.p) > {max_chars} THEN w.n + ceil(length(q.p) / {max_chars}.0)::BIGINT
             WHEN w.is_slice OR w.open_ + 2 + length(q.p) > {max_chars} THEN w.n + 1
             ELSE w.n END,
        CASE WHEN length(q.p) > {max_chars} OR w.is_slice OR w.open_ + 2 + length(q.p) > {max_chars} THEN w.n + 1 ELSE w.n END,
        length(q.p) > {max_chars}, q.p
      FROM pack w JOIN paras q ON q.k = w.k AND q.i = w.i + 1),
    whole AS (
      SELECT k, n AS no, string_agg(p, chr(10) || chr(10) ORDER BY i) AS chunk_text FROM pack WHERE NOT is_slice GROUP BY k, n),
    sliced AS (
      SELECT k, n_before + s AS no, substring(p, s * {max_chars} + 1, {max_chars}) AS chunk_text
      FROM (SELECT *, unnest(range(0, ceil(length(p) / {max_chars}.0)::BIGINT)) AS s FROM pack WHERE is_slice)),
    chunks AS (
      SELECT k AS {key}, (no - 1)::BIGINT AS chunk_index, count(*) OVER (PARTITION BY k)::BIGINT AS total_chunks, chunk_text
      FROM (SELECT * FROM whole UNION ALL SELECT * FROM sliced))
    """


def _chunk_rows(df, key: str):
    return df.select(
        key, F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("total_chunks").cast("bigint").alias("total_chunks"),
        F.col("approx_tokens").cast("bigint").alias("approx_tokens"), "chunk_text",
    )


_CHUNK_OUT = "chunk_index, total_chunks, greatest(1, length(chunk_text) // 4)::BIGINT AS approx_tokens, chunk_text FROM chunks"


@query("boilerplate_strip", f"SELECT page_id, {boilerplate_sql('html')} AS cleaned FROM pages")
def boilerplate_strip(spark, sf):
    pages = table(spark, sf, "pages", "page_id html")
    return pages.select("page_id", tx.strip_boilerplate(F.col("html")).alias("cleaned"))


@query("token_estimate", "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS approx_tokens FROM documents")
def token_estimate(spark, sf):
    docs = table(spark, sf, "documents", "doc_id text")
    return docs.select("doc_id", tx.estimate_tokens(F.col("text")).cast("bigint").alias("approx_tokens"))


_PAGE_TEXT = "replace(html, '</p>', '</p>' || chr(10) || chr(10))"
_DOC_TEXT = "replace(text, chr(10), chr(10) || chr(10))"


@query("chunk_pages", packing_sql("page_id", _PAGE_TEXT, "pages", 2000) + f"SELECT page_id, {_CHUNK_OUT}")
def chunk_pages(spark, sf):
    pages = table(spark, sf, "pages", "page_id html").select("page_id", F.expr(_PAGE_TEXT).alias("raw"))
    return _chunk_rows(chunk_documents(pages, "raw", max_tokens=500), "page_id")


@query("chunk_documents", packing_sql("doc_id", _DOC_TEXT, "documents", 400) + f"SELECT doc_id, {_CHUNK_OUT}")
def chunk_docs(spark, sf):
    docs = table(spark, sf, "documents", "doc_id text").select("doc_id", F.expr(_DOC_TEXT).alias("raw"))
    return _chunk_rows(chunk_documents(docs, "raw", max_tokens=100), "doc_id")


@query(
    "chunk_default_limit",
    packing_sql("doc_id", "text", "documents", 24000) + f"SELECT doc_id, {_CHUNK_OUT}",
)
def chunk_default_limit(spark, sf):
    docs = table(spark, sf, "documents", "doc_id text")
    return _chunk_rows(chunk_documents(docs, "text"), "doc_id")


@query(
    "chunk_turns",
    packing_sql("id", _DOC_TEXT, "(SELECT conv_id || ':' || turn AS id, text FROM conversations)", 120)
    + f"SELECT id, {_CHUNK_OUT}",
)
def chunk_turns(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.expr(_DOC_TEXT).alias("raw")
    )
    return _chunk_rows(chunk_documents(turns, "raw", max_tokens=30), "id")


@query(
    "chunk_counts",
    packing_sql("page_id", _PAGE_TEXT, "pages", 2000)
    + """SELECT page_id, count(*)::BIGINT AS n_chunks,
           sum(greatest(1, length(chunk_text) // 4))::BIGINT AS n_tokens, max(length(chunk_text))::BIGINT AS longest
         FROM chunks GROUP BY page_id""",
)
def chunk_counts(spark, sf):
    """Boilerplate, packing and counts per page: no shuffle, chunks never leave their row."""
    pages = table(spark, sf, "pages", "page_id html")

    def summary(chunks):
        tokens = F.transform(chunks, lambda c: tx.estimate_tokens(c).cast("bigint"))
        return F.struct(
            F.size(chunks).cast("bigint").alias("n_chunks"),
            F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_tokens"),
            F.array_max(F.transform(chunks, lambda c: F.length(c))).cast("bigint").alias("longest"),
        )

    # A filter on the chunks would be pushed below and pack every page twice.
    counted = F.transform(F.array(tx.chunk_array(F.expr(_PAGE_TEXT), 500)), summary)
    return pages.select("page_id", F.inline(F.filter(counted, lambda s: s["n_chunks"] > 0)))


@query(
    "hard_slice",
    """SELECT doc_id, s AS slice_index, substring(text, s * 1000 + 1, 1000) AS slice
       FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS s FROM documents)""",
)
def hard_slice(spark, sf):
    docs = table(spark, sf, "documents", "doc_id text")
    rows = docs.select("doc_id", F.posexplode(tx.hard_slices(F.col("text"), 1000)).alias("slice_index", "slice"))
    return rows.withColumn("slice_index", F.col("slice_index").cast("bigint"))


@query(
    "midpoint_split",
    """SELECT doc_id, 0::BIGINT AS half, substring(text, 1, length(text) // 2) AS piece FROM documents
       UNION ALL SELECT doc_id, 1, substring(text, length(text) // 2 + 1) FROM documents""",
)
def midpoint_split(spark, sf):
    docs = table(spark, sf, "documents", "doc_id text")
    rows = docs.select("doc_id", F.posexplode(tx.midpoint_halves(F.col("text"))).alias("half", "piece"))
    return rows.withColumn("half", F.col("half").cast("bigint"))


_FENCED = """CASE doc_id % 6
    WHEN 0 THEN '```json' || chr(10) || text || chr(10) || '```'
    WHEN 1 THEN '  ```' || chr(10) || text || '```  '
    WHEN 2 THEN '```' || lang || '```'
    WHEN 3 THEN '```' || chr(10) || text
    WHEN 4 THEN text || chr(10) || '```'
    ELSE text END"""


@query(
    "code_fence_strip",
    f"""WITH t AS (SELECT doc_id, {strip_sql(_FENCED)} AS t FROM documents),
        o AS (SELECT doc_id, t, CASE WHEN contains(t, chr(10)) THEN substring(t, instr(t, chr(10)) + 1) ELSE t END AS b FROM t)
        SELECT doc_id, {strip_sql("CASE WHEN NOT starts_with(t, '```') THEN t WHEN ends_with(b, '```') THEN left(b, length(b) - 3) ELSE b END")} AS reply
        FROM o""",
)
def code_fence_strip(spark, sf):
    docs = table(spark, sf, "documents", "doc_id text lang")
    return docs.select("doc_id", tx.strip_code_fences(F.expr(_FENCED)).alias("reply"))


@query("text_excerpt", "SELECT doc_id, substring(text, 1, 500) AS excerpt FROM documents")
def text_excerpt(spark, sf):
    docs = table(spark, sf, "documents", "doc_id text")
    return docs.select("doc_id", tx.excerpt(F.col("text"), 500).alias("excerpt"))


@query(
    "url_netloc",
    "SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain FROM pages",
)
def url_netloc(spark, sf):
    return table(spark, sf, "pages", "page_id url").select("page_id", u.netloc(F.col("url")).alias("domain"))


_REPO_URL = """CASE doc_id % 7
    WHEN 0 THEN 'https://github.com/' || source || '/doc-' || doc_id
    WHEN 1 THEN 'https://github.com/' || source || '/doc.' || doc_id || '.git'
    WHEN 2 THEN ' http://github.com/' || source || '/' || lang || '_' || doc_id || '/ '
    WHEN 3 THEN 'https://github.com/' || source || '/' || doc_id || '/tree/main'
    WHEN 4 THEN 'https://github.com/' || source || '?tab=' || doc_id
    WHEN 5 THEN 'https://example.com/' || source || '/' || doc_id
    ELSE 'github.com/' || source || '/' || doc_id || '.git/' END"""
_REPO_PATTERN = r"github\.com/([\w.-]+)/([\w.-]+?)(?:\.git)?/?$"
_REPO_SQL = f"""SELECT doc_id, regexp_extract(trim({_REPO_URL}), '{_REPO_PATTERN}', 1) AS owner,
    regexp_extract(trim({_REPO_URL}), '{_REPO_PATTERN}', 2) AS repo FROM documents"""


@query("owner_repo", f"SELECT doc_id, nullif(owner, '') AS owner, nullif(repo, '') AS repo FROM ({_REPO_SQL})")
def owner_repo(spark, sf):
    docs = table(spark, sf, "documents", "doc_id source lang")
    return docs.select("doc_id", u.owner_repo(F.expr(_REPO_URL)).alias("r")).select("doc_id", "r.owner", "r.repo")


@query(
    "star_enrichment",
    f"""SELECT d.doc_id, s.stars AS github_stars FROM ({_REPO_SQL}) d
        LEFT JOIN (SELECT o.source AS owner, 'doc-' || o.doc_id AS repo, o.n_chars AS stars
                   FROM documents o JOIN labels l ON l.doc_id = o.doc_id) s ON s.owner = d.owner AND s.repo = d.repo""",
)
def star_enrichment(spark, sf):
    docs = table(spark, sf, "documents", "doc_id source lang n_chars")
    labelled = docs.join(table(spark, sf, "labels", "doc_id"), "doc_id")
    stars = labelled.select(F.col("source").alias("owner"), F.expr("'doc-' || doc_id").alias("repo"), F.col("n_chars").alias("stars"))
    return enrich_stars(docs.select("doc_id", F.expr(_REPO_URL).alias("github_url")), stars).select("doc_id", "github_stars")


def _snapshot_stars(owner: str, repo: str) -> int | None:
    """Offline stand-in for a repository service: every third repository is gone."""
    number = int(re.search(r"\d+$", repo)[0])
    if number % 3 == 0:
        raise OSError("gone")
    return number * 7 + len(owner)


@query(
    "star_lookup",
    f"""SELECT doc_id, CASE WHEN n % 3 <> 0 THEN n * 7 + length(owner) END AS github_stars
        FROM (SELECT *, nullif(regexp_extract(repo, '[0-9]+$'), '')::BIGINT AS n FROM ({_REPO_SQL}))""",
)
def star_lookup(spark, sf):
    """Every distinct repository is looked up once, then joined."""
    papers = table(spark, sf, "documents", "doc_id source lang").select("doc_id", F.expr(_REPO_URL).alias("github_url"))
    stars = Workspace(spark).materialize(look_up_stars(papers, _snapshot_stars), "stars")
    return enrich_stars(papers, stars).select("doc_id", "github_stars")


_ARXIV = "'https://arxiv.org/abs/' || lpad('' || (o_orderkey % 30), 2, '0') || lpad('' || (o_custkey % 12 + 1), 2, '0') || '.' || o_orderkey"


@query(
    "arxiv_month",
    f"""SELECT o_orderkey, '20' || regexp_extract({_ARXIV}, '/([0-9]{{2}})([0-9]{{2}})[^/]*$', 1) || '-'
        || regexp_extract({_ARXIV}, '/([0-9]{{2}})([0-9]{{2}})[^/]*$', 2) || '-01T00:00:00' AS published_date FROM orders""",
)
def arxiv_month(spark, sf):
    orders = table(spark, sf, "orders", "o_orderkey o_custkey")
    return orders.select("o_orderkey", u.arxiv_month_start(F.expr(_ARXIV)).alias("published_date"))


@query("slug_url", "SELECT s_suppkey, 'https://example.com/companies/' || lower(s_name) AS source_url FROM supplier")
def slug_url(spark, sf):
    return table(spark, sf, "supplier", "s_suppkey s_name").select(
        "s_suppkey", u.slug_url("https://example.com/companies/", F.lower("s_name")).alias("source_url")
    )
