"""Registered queries of this subpackage: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Workspace
from .common import documents, query, words
from .edit_counts import apply_edits, build_trees, numbers_and_breaks
from .exact_dedup import ExactDedup
from .feistel import shuffle_shards
from .grammar_files import read_token_files, write_token_files
from .line_rules import apply_line_rules
from .minhash import near_copies
from .mixing import poisson_mix
from .packing import pack
from .periodic_runs import periodic_runs
from .role_repair import repair_roles
from .secret_scan import scan_secrets
from .signature_join import similar_components
from .spelling import spelling_variants

SHARDS = 40
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
SHUFFLE_KEY = 20_240_607

LINE_RULES_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 8),
wins AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 7)) AS n FROM places),
starts AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM wins WHERE n > 1),
repeats AS (SELECT doc_id, sum(least(8, coalesce(j - i, 8)))::BIGINT AS n FROM starts GROUP BY doc_id),
numbered AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM base),
each_line AS (
  SELECT doc_id, k, lines[k] AS x,
         list_filter(string_split_regex(lines[k], '[\x20\x09-\x0D]+'), lambda v: v <> '') AS lw FROM numbered),
judged AS (
  SELECT doc_id, k, x, length(x) AS chars,
    ((length(x) - length(translate(x, '#*$%&|<>', ''))) * 20 > length(x)
     OR (len(lw) < 6 AND NOT regexp_matches(regexp_replace(x, '[\x20\x09-\x0D]+$', ''), '[.!?:;…"''”’»)\]]$'))
     OR (len(lw) >= 5 AND length(regexp_replace(x, '[^A-Z]', '', 'g')) * 2 > length(regexp_replace(x, '[^A-Za-z]', '', 'g')))
     OR (length(x) - length(translate(x, '|»›•·→', '')) >= 3
         AND (length(x) - length(translate(x, '|»›•·→', ''))) * 6 >= len(lw))
     OR (len(lw) <= 40 AND regexp_matches(lower(x), 'cookie|privacy policy|terms of use|terms of service|all rights reserved|javascript|click here|sign up|log in|subscribe|newsletter|share this|read more|skip to content'))
     OR (len(lw) >= 10 AND len(list_distinct(lw)) * 5 < len(lw))) AS fails
  FROM each_line),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, x ORDER BY k) AS nth FROM judged),
sums AS (
  SELECT doc_id, sum(chars)::BIGINT AS all_chars, count(*)::BIGINT AS n_lines,
         coalesce(sum(chars) FILTER (WHERE NOT fails AND nth = 1), 0)::BIGINT AS good_chars,
         count(*) FILTER (WHERE NOT fails AND nth = 1)::BIGINT AS good_lines
  FROM firsts GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_lines - good_lines, 0)::BIGINT AS n_failed_lines,
         coalesce(all_chars - good_chars, 0)::BIGINT AS lost_chars, coalesce(all_chars, 0) AS all_chars
  FROM base LEFT JOIN repeats USING (doc_id) LEFT JOIN sums USING (doc_id)),
verdict AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_chars <= all_chars * 0.5 AS kept, n_lines, n_failed_lines, lost_chars
FROM verdict
"""

EXACT_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

MIX_SQL = """
WITH stats AS (SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS mass FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(mass) FROM stats) / (SELECT sum(sqrt(mass)) FROM stats) * sqrt(mass) / mass AS rate FROM stats),
ks AS (SELECT source, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k FROM rates),
cdf AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS f FROM ks),
drawn AS (
  SELECT d.doc_id, d.source, strlen(coalesce(d.text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5('0:' || d.doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM documents d),
counted AS (
  SELECT doc_id, any_value(source) AS source, any_value(n_bytes) AS n_bytes, count(*) FILTER (WHERE f <= u)::BIGINT AS copies
  FROM drawn JOIN cdf USING (source) GROUP BY doc_id)
SELECT doc_id, source, n_bytes, copies AS mix_copies, unnest(range(0, copies)) AS mix_copy FROM counted
"""


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_edit_counts")
def edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a digit are masked and line breaks doubled; the counts follow without a second encoding.

    Null and empty texts have one segment without tokens; rows with equal or null ids count each for itself.
    """
    trees = Workspace(spark).materialize(build_trees(documents(spark, sf_dir), tokenizer_path()), "token-trees")
    return apply_edits(trees, tokenizer_path(), numbers_and_breaks)


@query("op2_grammar_files")
def grammar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written in the file format and read back, per document.

    Null text is empty and gives the end id alone; equal ids keep an order of their own; an empty table gives no rows.
    """
    path = Workspace(spark).path("token-files")
    write_token_files(documents(spark, sf_dir), path, tokenizer_path(), END_ID)
    return read_token_files(spark, path)


@query("op3_feistel_shards")
def feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal row counts by a permutation of global row numbers (law `rows`).

    Null text has a size of 16 and the crc32 of no bytes; equal texts and equal ids are rows of their own.
    """
    placed = shuffle_shards(documents(spark, sf_dir), SHARDS, SHUFFLE_KEY)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row", "position",
    )


@query("op4_poisson_mix", MIX_SQL)
def poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy, with its whole text shuffled; the digest leaves the text out.

    Null text counts one byte of mass; a null source is a source; rows that repeat an id draw the same count.
    """
    mixed = poisson_mix(documents(spark, sf_dir))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return mixed.select("doc_id", "source", n_bytes.alias("n_bytes"), "mix_copies", "mix_copy")


@query("op5_line_rules", LINE_RULES_SQL)
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document.

    Null and empty texts have no words and fail the base rules; of equal lines the first stays; rows are independent.
    """
    return apply_line_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_failed_lines", "lost_chars",
    )


@query("op6_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document, those of the rules and those of the network.

    Null text is empty and has no spans; at one start the kinds come in the order of the rules; rows are independent.
    """
    return scan_secrets(documents(spark, sf_dir))


@query("op7_signature_join")
def signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of four-word shingle sets of 85 percent similarity or more.

    Texts without words stay alone; rows that repeat an id are one document; a null id has a null component.
    """
    return similar_components(documents(spark, sf_dir), n=4, percent=85)


@query("op8_role_repair")
def role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired and rendered turns of every conversation.

    Null roles and texts, repeated turns and clashing columns are as `repair_roles` says.
    """
    return repair_roles(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("place")


@query("op9_best_fit")
def best_fit_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of all pieces; clusters are the groups of equal texts, null as empty.

    A row of length zero has one piece without a bin; rows that repeat an id are packed each (see `pack`).
    """
    docs = documents(spark, sf_dir)
    return pack(docs, cluster=F.xxhash64(F.coalesce("text", F.lit(""))))


@query("op10_exact_dedup", EXACT_SQL)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts; null is empty.

    Of rows that repeat the largest id and the text all are flagged as kept.
    """
    return ExactDedup(documents(spark, sf_dir)).decisions()


def with_period(docs: DataFrame) -> DataFrame:
    """The rows whose crc32 ends in 0 go on periodically from a word that it names, as the contract of op11 says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = words(F.col("text"))
    g = F.floor(F.col("h") / 10)
    a = F.pmod(F.col("g"), F.col("n")).cast("int")
    p = (1 + F.floor((F.col("n") - a) / (3 + F.pmod(F.col("g"), F.lit(8))))).cast("int")
    rest = (F.col("n") - a).cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil(rest / p).cast("int")))
    text = F.concat_ws(" ", F.slice("w", F.lit(1), a), F.slice(again, F.lit(1), rest))
    chosen = F.pmod(h, F.lit(10)) == 0
    docs = docs.select("doc_id", "text", h.alias("h"), F.when(chosen, w).alias("w"))
    docs = docs.withColumns({"g": g, "n": F.size("w")})
    return docs.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def repeated_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, some of them made periodic; digests are taken from the runs and the collapsed texts."""
    found = periodic_runs(with_period(documents(spark, sf_dir)))
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumns({"best": best, "listed": F.concat_ws("", lines)})
    period = -F.col("best.p")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div -best.p").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


@query("op12_spelling_variants")
def variant_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the whole corpus, some of them damaged as the contract says, with their forms and roots."""
    return spelling_variants(documents(spark, sf_dir), damage=199)


@query("op13_minhash_dedup")
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of three-word shingle sets of 85 percent similarity or more; the smallest id of each is kept.

    Texts without words stay alone; rows that repeat an id are one document; a null id has null component and verdict.
    """
    return near_copies(documents(spark, sf_dir), n=3, percent=85)
