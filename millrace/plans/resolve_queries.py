"""Entity-resolution queries over names spelled in many ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import LEGAL_FORM_WORDS, exact_key, normalized_key, token_sorted
from ..operators import resolve as rs
from ..operators.similarity import token_sort_ratio
from ..sources.seeds import seed_aliases
from .catalog import query, table
from .text_queries import strip_sql

# Part names in the spellings that occur in the wild: case, company forms, token
# order, typos, blanks, names made of company forms only.
PART_NAME = """CASE p_partkey % 13
    WHEN 0 THEN p_name || ' ' || p_brand
    WHEN 1 THEN upper(p_name || ' ' || p_brand)
    WHEN 2 THEN p_name || ' ' || p_brand || ' Inc.'
    WHEN 3 THEN p_name || ', ' || p_brand || ' LLC'
    WHEN 4 THEN p_brand || ' ' || p_name
    WHEN 5 THEN substring(p_name, 1, 2) || substring(p_name, 4) || ' ' || p_brand
    WHEN 6 THEN p_name || ' Labs'
    WHEN 7 THEN p_name || 'x ' || lower(p_type)
    WHEN 8 THEN '  ' || p_name || ' Holding ' || p_type || '  '
    WHEN 9 THEN CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE NULL END
    WHEN 10 THEN p_name
    WHEN 11 THEN CASE WHEN p_partkey % 3 = 0 THEN 'Labs' WHEN p_partkey % 3 = 1 THEN '!!!' ELSE p_name || 's' END
    ELSE p_name || ' & ' || p_type || ' GmbH' END"""

NAMES_SQL = f"SELECT p_partkey AS ord, {PART_NAME} AS raw FROM part"
# Known entities: every distinct part name with one alias, in order of first appearance.
SEEDS_SQL = """SELECT canonical, CASE place WHEN 0 THEN canonical ELSE canonical || ' Works' END AS alias,
      entity_order * 1000000 + place AS position
    FROM (SELECT p_name AS canonical, min(p_partkey) AS entity_order, unnest([0, 1]) AS place FROM part GROUP BY p_name)"""


def exact_sql(x: str) -> str:
    return strip_sql(f"lower({x})")


def normalized_sql(x: str) -> str:
    x = rf"regexp_replace({exact_sql(x)}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
    x = rf"regexp_replace({x}, '\b({'|'.join(LEGAL_FORM_WORDS)})\b', ' ', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def token_sorted_sql(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def subsequence_ctes(pairs: str) -> str:
    """CTEs ``lcs_steps`` and ``scored(a, b, score)`` for the distinct pairs in CTE ``pairs(a, b)``.

    The common-subsequence table is filled one row (one character of a) per step.
    """
    return f"""
    lcs_steps(a, b, i, cells) AS (
      SELECT a, b, 0::BIGINT, list_transform(range(0, length(b) + 1), lambda j: 0::BIGINT) FROM {pairs}
      UNION ALL
      SELECT a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: greatest(cells[j + 1],
        coalesce(list_max(list_transform(range(1, j + 1), lambda k: cells[k] + CASE WHEN substring(b, k, 1) = substring(a, i + 1, 1) THEN 1 ELSE 0 END)), 0)))
      FROM lcs_steps WHERE i < length(a)),
    scored AS (
      SELECT a, b, (1.0::DOUBLE - (length(a) + length(b) - 2 * cells[length(b) + 1])::DOUBLE / (length(a) + length(b))) * 100.0::DOUBLE AS score
      FROM lcs_steps WHERE i = length(a))"""


def resolution_sql(names: str, seeds: str, select: str, threshold: float = 90.0) -> str:
    """The sequential rule as SQL over ``names(ord, raw)`` and ``seeds(canonical, alias, position)``.

    ``select`` reads CTE ``resolved(ord, raw, canonical_name, method, confidence)``.
    """
    near = f"levenshtein(x.ts, y.ts) <= (length(x.ts) + length(y.ts)) * {(100 - threshold) / 100} + 1e-9"
    return f"""
    WITH RECURSIVE names AS MATERIALIZED ({names}), seeds AS MATERIALIZED ({seeds}),
    occ AS MATERIALIZED (
      SELECT ord, raw, CASE WHEN raw IS NULL OR {strip_sql("raw")} = '' THEN NULL ELSE {exact_sql("raw")} END AS ek,
        {normalized_sql("raw")} AS nk FROM names),
    keyed AS MATERIALIZED (SELECT *, {token_sorted_sql("nk")} AS ts FROM occ),
    seed_exact AS MATERIALIZED (SELECT {exact_sql("alias")} AS ek, arg_max(canonical, position) AS canonical FROM seeds GROUP BY 1),
    seed_norm AS MATERIALIZED (
      SELECT {normalized_sql("alias")} AS nk, arg_max(canonical, position) AS canonical, min(position) AS position FROM seeds GROUP BY 1),
    seed_ts AS MATERIALIZED (SELECT {token_sorted_sql("nk")} AS ts, canonical, position FROM seed_norm),
    vertices AS MATERIALIZED (
      SELECT ts, min(ord) AS ord, row_number() OVER (ORDER BY min(ord)) AS no FROM keyed
      WHERE ek IS NOT NULL AND nk NOT IN (SELECT nk FROM seed_norm) GROUP BY ts),
    pairs AS MATERIALIZED (
      SELECT DISTINCT x.ts AS a, y.ts AS b FROM vertices x JOIN (SELECT ts FROM vertices UNION SELECT ts FROM seed_ts) y ON x.ts <> y.ts AND {near}),
    {subsequence_ctes("pairs")},
    edges AS MATERIALIZED (SELECT a, b, score FROM scored WHERE score >= {threshold}),
    taken AS MATERIALIZED (
      SELECT ts FROM vertices WHERE ts IN (SELECT ts FROM seed_ts) UNION
      SELECT a FROM edges WHERE b IN (SELECT ts FROM seed_ts)),
    earlier AS MATERIALIZED (
      SELECT v.no, v.ts, v.ts IN (SELECT ts FROM taken) AS is_taken,
        coalesce(list(u.no) FILTER (u.no < v.no), []) AS before
      FROM vertices v LEFT JOIN edges e ON e.a = v.ts LEFT JOIN vertices u ON u.ts = e.b GROUP BY ALL),
    walk(no, leaders) AS (
      SELECT 0::BIGINT, []::BIGINT[]
      UNION ALL
      SELECT e.no, CASE WHEN e.is_taken OR list_has_any(w.leaders, e.before) THEN w.leaders ELSE list_append(w.leaders, e.no) END
      FROM walk w JOIN earlier e ON e.no = w.no + 1),
    leader_nos AS MATERIALIZED (SELECT unnest(leaders) AS no FROM walk WHERE no = (SELECT max(no) FROM walk)),
    leaders AS MATERIALIZED (
      SELECT v.ts, v.ord, k.nk, k.ek, {strip_sql("k.raw")} AS canonical
      FROM leader_nos l JOIN vertices v USING (no) JOIN keyed k ON k.ord = v.ord),
    entries AS MATERIALIZED (
      SELECT ts, 0 AS tier, position AS place, canonical FROM seed_ts UNION ALL SELECT ts, 1, ord, canonical FROM leaders),
    fuzzy AS (
      SELECT k.ord, arg_min(e.canonical, (-s.score, e.tier, e.place)) AS canonical, max(s.score) AS score
      FROM keyed k JOIN (SELECT a, b, score FROM edges UNION ALL SELECT ts, ts, 100.0 FROM vertices) s ON s.a = k.ts
      JOIN entries e ON e.ts = s.b AND (e.tier = 0 OR e.place < k.ord) GROUP BY k.ord),
    resolved AS (
      SELECT k.ord, k.raw,
        CASE WHEN k.ek IS NULL THEN k.raw ELSE coalesce(x.canonical, n.canonical, l.canonical, f.canonical) END AS canonical_name,
        CASE WHEN k.ek IS NULL THEN 'skipped_empty' WHEN x.canonical IS NOT NULL THEN 'exact' WHEN n.canonical IS NOT NULL THEN 'normalized'
          WHEN l.ord = k.ord THEN 'new_entity' WHEN l.ek = k.ek THEN 'exact' WHEN l.ord IS NOT NULL THEN 'normalized' ELSE 'fuzzy' END AS method,
        CASE WHEN k.ek IS NULL THEN 0.0 WHEN x.canonical IS NOT NULL THEN 1.0 WHEN n.canonical IS NOT NULL THEN 0.97
          WHEN l.ord = k.ord OR l.ek = k.ek THEN 1.0 WHEN l.ord IS NOT NULL THEN 0.97 ELSE f.score / 100.0 END::DOUBLE AS confidence
      FROM keyed k LEFT JOIN seed_exact x ON x.ek = k.ek LEFT JOIN seed_norm n ON n.nk = k.nk AND k.ek IS NOT NULL
      LEFT JOIN leaders l ON l.nk = k.nk AND k.ek IS NOT NULL LEFT JOIN fuzzy f ON f.ord = k.ord)
    {select}"""


def part_names(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.expr(PART_NAME).alias("raw"))


def part_seeds(spark, sf):
    first = table(spark, sf, "part", "p_name p_partkey").groupBy("p_name").agg(F.min("p_partkey").alias("entity_order"))
    aliases = F.array(F.concat("p_name", F.lit(" Works")))
    return seed_aliases(first.select("entity_order", F.col("p_name").alias("canonical"), aliases.alias("aliases")))


@query("exact_key", f"SELECT p_partkey, {exact_sql(PART_NAME)} AS exact_key FROM part")
def exact_keys(spark, sf):
    return table(spark, sf, "part").select("p_partkey", exact_key(F.expr(PART_NAME)).alias("exact_key"))


@query(
    "normalized_key",
    f"SELECT ord AS p_partkey, {normalized_sql('raw')} AS norm_key, {token_sorted_sql(normalized_sql('raw'))} AS sorted_key FROM ({NAMES_SQL})",
)
def normalized_keys(spark, sf):
    key = normalized_key(F.expr(PART_NAME))
    return table(spark, sf, "part").select("p_partkey", key.alias("norm_key"), token_sorted(key).alias("sorted_key"))


_KEY = token_sorted_sql(normalized_sql("raw"))


@query(
    "token_sort_score",
    f"""WITH RECURSIVE t AS MATERIALIZED (SELECT n.ord, {_KEY} AS a, {token_sorted_sql("lower(p_name)")} AS b FROM ({NAMES_SQL}) n JOIN part ON p_partkey = n.ord),
        pairs AS MATERIALIZED (SELECT DISTINCT a, b FROM t WHERE a IS NOT NULL), {subsequence_ctes("pairs")}
        SELECT t.ord AS p_partkey, s.score FROM t LEFT JOIN scored s ON s.a = t.a AND s.b = t.b""",
)
def token_sort_score(spark, sf):
    parts = table(spark, sf, "part")
    a, b = token_sorted(normalized_key(F.expr(PART_NAME))), token_sorted(F.lower("p_name"))
    return parts.select("p_partkey", a.alias("a"), b.alias("b")).select("p_partkey", token_sort_ratio(F.col("a"), F.col("b")).alias("score"))


@query(
    "seed_index",
    f"""SELECT {normalized_sql("alias")} AS norm_key, arg_max(canonical, position) AS seed_norm, min(position) AS position
        FROM ({SEEDS_SQL}) GROUP BY 1""",
)
def seed_index(spark, sf):
    return rs.normalized_index(part_seeds(spark, sf))


@query(
    "match_exact",
    f"""SELECT n.ord, s.canonical AS seed_exact FROM ({NAMES_SQL}) n
        LEFT JOIN (SELECT {exact_sql("alias")} AS k, arg_max(canonical, position) AS canonical FROM ({SEEDS_SQL}) GROUP BY 1) s
        ON s.k = {exact_sql("n.raw")}""",
)
def match_exact(spark, sf):
    return rs.match_exact(part_names(spark, sf), "raw", part_seeds(spark, sf)).select("ord", "seed_exact")


@query(
    "match_normalized",
    f"""SELECT n.ord, s.canonical AS seed_norm FROM ({NAMES_SQL}) n
        LEFT JOIN (SELECT {normalized_sql("alias")} AS k, arg_max(canonical, position) AS canonical FROM ({SEEDS_SQL}) GROUP BY 1) s
        ON s.k = {normalized_sql("n.raw")}""",
)
def match_normalized(spark, sf):
    return rs.match_normalized(part_names(spark, sf), "raw", part_seeds(spark, sf)).select("ord", "seed_norm")


@query(
    "match_fuzzy",
    f"""WITH RECURSIVE k AS MATERIALIZED (SELECT DISTINCT {normalized_sql("raw")} AS nk FROM ({NAMES_SQL}) WHERE raw IS NOT NULL),
        s AS MATERIALIZED (
          SELECT {token_sorted_sql(normalized_sql("alias"))} AS ts, arg_min(canonical, position) AS canonical, min(position) AS position
          FROM ({SEEDS_SQL}) GROUP BY 1),
        t AS MATERIALIZED (SELECT nk, {token_sorted_sql("nk")} AS ts FROM k),
        pairs AS MATERIALIZED (SELECT DISTINCT t.ts AS a, s.ts AS b FROM t JOIN s ON t.ts <> s.ts AND levenshtein(t.ts, s.ts) <= 0.2 * (length(t.ts) + length(s.ts))),
        {subsequence_ctes("pairs")}
        SELECT t.nk AS norm_key, arg_min(s.canonical, (-m.score, s.position)) AS canonical, max(m.score) AS score
        FROM t JOIN (SELECT a, b, score FROM scored WHERE score >= 80 UNION ALL SELECT ts, ts, 100.0 FROM s) m ON m.a = t.ts
        JOIN s ON s.ts = m.b GROUP BY t.nk""",
)
def match_fuzzy(spark, sf):
    return rs.match_fuzzy(part_names(spark, sf), "raw", part_seeds(spark, sf), threshold=80.0)


def _resolved(spark, sf):
    return rs.resolve(part_names(spark, sf), "raw", "ord", part_seeds(spark, sf))


@query("resolve_all", resolution_sql(NAMES_SQL, SEEDS_SQL, "SELECT * FROM resolved"))
def resolve_all(spark, sf):
    return _resolved(spark, sf)


@query(
    "new_entities",
    resolution_sql(NAMES_SQL, SEEDS_SQL, "SELECT ord, canonical_name FROM resolved WHERE method = 'new_entity'"),
)
def new_entities(spark, sf):
    return _resolved(spark, sf).filter(F.col("method") == rs.NEW_ENTITY).select("ord", "canonical_name")


@query(
    "mapping_log",
    resolution_sql(
        NAMES_SQL,
        SEEDS_SQL,
        "SELECT raw AS raw_name, canonical_name, method, round_even(confidence, 3)::DOUBLE AS confidence FROM resolved",
    ),
)
def mapping_log(spark, sf):
    return rs.mapping_log(_resolved(spark, sf), "raw")


@query(
    "log_by_method",
    resolution_sql(
        NAMES_SQL,
        SEEDS_SQL,
        """SELECT method, count(*)::BIGINT AS n, round(avg(round_even(confidence, 3)), 6)::DOUBLE AS avg_confidence
           FROM resolved GROUP BY method""",
    ),
)
def log_by_method(spark, sf):
    log = rs.log_by_method(rs.mapping_log(_resolved(spark, sf), "raw"))
    return log.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("resolve_sliced", resolution_sql(NAMES_SQL, SEEDS_SQL, "SELECT * FROM resolved"))
def resolve_sliced(spark, sf):
    """Limits so tight that slices, one parallel round, components and the grid of hot cells are all used."""
    limits = rs.ElectionLimits(first_slice=200, smallest_slice=100, first_pairs_per_key=5, pairs_per_core=500, checks_per_task=100, parallel_rounds=1)
    return rs.resolve(part_names(spark, sf), "raw", "ord", part_seeds(spark, sf), limits=limits)


# Supplier names differ in digits only: nearly every pair is a near copy.
_SUPPLIERS_SQL = "SELECT s_suppkey AS ord, s_name AS raw FROM supplier"


@query("resolve_near_copies", resolution_sql(_SUPPLIERS_SQL, SEEDS_SQL, "SELECT * FROM resolved"))
def resolve_near_copies(spark, sf):
    """One leader absorbs a mass of near copies; slices keep their pairs from being formed."""
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("raw"))
    return rs.resolve(names, "raw", "ord", part_seeds(spark, sf), limits=rs.ElectionLimits(first_slice=500, smallest_slice=200))
