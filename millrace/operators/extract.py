"""Record extraction through a chain of providers.

The per-chunk state machine (retry, next provider, halve and start over) runs as waves
over a DataFrame.  A wave calls each open chunk's current provider in Arrow batches (at most `concurrency` calls in
the job at once, and a chunk that waits for a retry holds none of them),
validates the replies natively and writes the outcome down, so a lost executor never
repeats the paid calls of an earlier wave.  There are at most
``providers * (max_splits + 1)`` waves, and later ones hold the failed chunks only.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce
from random import uniform
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.prompts import extraction_prompt
from ..functions.records import envelope, typed_content, validate_reply
from ..functions.text import midpoint_halves
from ..schemas import RECORD_TYPES
from ..session import Workspace
from ..sources.providers import PayloadTooLarge, Provider, RateLimited, TransportError, Unavailable
from .calls import CallTimeout, Steps, run_by_due_time, task_permits
from .chunking import chunk_documents

REPLY, EXHAUSTED, TOO_LARGE = "reply", "exhausted", "too_large"
ENTITY, FAILURE = "entity", "failure"
ALL_FAILED, STILL_TOO_LARGE = "all_providers_exhausted_or_unconfigured", "oversized_after_max_splits"

_ATTEMPT = T.StructType(
    [
        T.StructField("provider", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("wait_seconds", T.DoubleType()),
    ]
)
_CALL = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("reply", T.StringType()),
        T.StructField("attempts", T.ArrayType(_ATTEMPT)),
    ]
)


@dataclass(frozen=True)
class ExtractionConfig:
    max_tokens_per_chunk: int = 6000
    max_retries_per_provider: int = 3
    base_backoff_seconds: float = 1.5
    max_backoff_seconds: float = 30.0
    max_chunk_splits: int = 3
    concurrency: int = 8  # calls in flight in the whole job
    call_timeout_seconds: float | None = 60.0
    partitions: int | None = None  # tasks of a wave; never more than there are permits
    sleep: Callable[[float], None] = time.sleep


def _call_with_retry(provider: Provider, prompt: str, config: ExtractionConfig) -> Steps:
    """The steps of one chunk with one provider."""
    attempts: list[dict] = []

    def log(outcome: str, wait: float = 0.0) -> None:
        attempts.append(
            {"provider": provider.name, "attempt": len(attempts) + 1, "outcome": outcome, "wait_seconds": wait}
        )

    status, reply = EXHAUSTED, None
    for attempt in range(1, config.max_retries_per_provider + 1):
        last = attempt == config.max_retries_per_provider
        try:
            reply = yield lambda: provider.complete(prompt)
            log("ok")
            status = REPLY
            break
        except PayloadTooLarge:
            log("payload_too_large")
            status = TOO_LARGE
            break
        except Unavailable:
            log("unavailable")
            break
        except RateLimited:
            delay = min(config.base_backoff_seconds * 2 ** (attempt - 1), config.max_backoff_seconds)
            wait = 0.0 if last else delay + uniform(0, delay / 2)
            log("rate_limited", wait)
        except (TransportError, CallTimeout) as error:
            wait = 0.0 if last else config.base_backoff_seconds
            log("timeout" if isinstance(error, CallTimeout) else "http_error", wait)
        except Exception as error:  # one bad row must not end the job
            log(f"error:{type(error).__name__}")
            break
        if wait:
            yield wait
    return {"status": status, "reply": reply, "attempts": attempts}


def _caller(providers: list[Provider], config: ExtractionConfig, tasks: int):
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        permits = task_permits(config.concurrency, tasks)
        for tiers, prompts in batches:
            rows = [_call_with_retry(providers[t], p, config) for t, p in zip(tiers, prompts, strict=True)]
            found = run_by_due_time(rows, permits, config.sleep, config.call_timeout_seconds)
            yield pd.DataFrame(found, columns=["status", "reply", "attempts"])

    # Calls have side effects: the optimizer must neither repeat nor move them.
    return F.pandas_udf(call, _CALL).asNondeterministic()


@dataclass(frozen=True)
class Extraction:
    """``outcomes``: one row per chunk; ``attempts``: one row per provider call."""

    outcomes: DataFrame
    attempts: DataFrame

    def entities(self, record_type: str, collected_at: Column | None = None) -> DataFrame:
        """Typed envelopes of one record type."""
        rows = self.outcomes.filter((F.col("status") == ENTITY) & (F.col("record_type") == record_type))
        entity = envelope(
            record_type, F.col("source_name"), F.col("source_url"),
            collected_at if collected_at is not None else F.col("reference_time"),
            typed_content(F.col("content"), record_type),
        )
        return rows.select("doc_id", "chunk_index", entity.alias("entity")).select("doc_id", "chunk_index", "entity.*")

    def failures(self) -> DataFrame:
        """The dead letters."""
        return self.outcomes.filter(F.col("status") == FAILURE).select(
            "doc_id", "source_url", F.col("sub_index").alias("chunk_index"), "reason", "detail"
        )


def extract(
    docs: DataFrame,
    providers: list[Provider],
    config: ExtractionConfig = ExtractionConfig(),
    record_types: tuple[str, ...] = RECORD_TYPES,
) -> Extraction:
    """Extract one record per chunk of ``(doc_id, record_type, raw_text, source_name,
    source_url, reference_time)``; further columns are not carried along."""
    spark = docs.sparkSession
    work = Workspace(spark)
    active = [p for p in providers if p.is_configured]
    docs = docs.select("doc_id", "record_type", "raw_text", "source_name", "source_url", "reference_time")
    chunks = chunk_documents(docs, "raw_text", config.max_tokens_per_chunk).select(
        "doc_id", "record_type", "source_name", "source_url", "reference_time", "chunk_index",
        F.array().cast("array<int>").alias("path"), F.col("chunk_index").cast("bigint").alias("sub_index"),
        F.lit(0).alias("tier"), F.col("chunk_text").alias("text"),
    )
    keys = ["doc_id", "record_type", "source_name", "source_url", "reference_time", "chunk_index"]
    carried = [*keys, "path", "sub_index", "tier", "text"]
    no_attempt = F.lit(None).cast(T.ArrayType(_ATTEMPT)).alias("attempts")

    def leaf(rows: DataFrame, status: str, reason: Column) -> DataFrame:
        return rows.select(
            *keys, "path", "sub_index", F.lit(status).alias("status"), "provider", reason.alias("reason"),
            "detail", "content",
        )

    no_call = [F.lit(None).cast("string").alias(c) for c in ("provider", "detail", "content")]
    if not active:
        leaves = [leaf(chunks.select(*carried, *no_call), FAILURE, F.lit(ALL_FAILED))]
        tried = [chunks.select("doc_id", "chunk_index", "path", no_attempt).limit(0)]
    else:
        leaves, tried = _waves(work, chunks, carried, active, config, record_types, leaf)

    first = F.struct((F.col("status") == FAILURE).alias("failed"), "path")
    outcome = F.struct("sub_index", "status", "provider", "reason", "detail", "content")
    # Of a split chunk the first entity counts, or else the first failure.
    outcomes = (
        reduce(DataFrame.unionByName, leaves).groupBy(*keys).agg(F.min_by(outcome, first).alias("o")).select(*keys, "o.*")
    )
    attempts = reduce(DataFrame.unionByName, tried).select(
        "doc_id", "chunk_index", "path", F.explode("attempts").alias("a")
    )
    return Extraction(outcomes, attempts.select("doc_id", "chunk_index", "path", "a.*"))


def _waves(work, chunks, carried, active, config, record_types, leaf) -> tuple[list[DataFrame], list[DataFrame]]:
    width = min(config.concurrency, config.partitions or int(work.spark.conf.get("spark.sql.shuffle.partitions")))
    call = _caller(active, config, width)
    name_of = F.array(*[F.lit(p.name) for p in active])
    leaves: list[DataFrame] = []
    tried: list[DataFrame] = []
    frontier = chunks
    prompt = extraction_prompt(F.col("record_type"), F.col("text"), F.col("reference_time"), F.col("source_name"))
    verdict = validate_reply(F.col("call.reply"), F.col("record_type"), record_types)
    while True:
        # Chunks of one large document spread over all callers.  Calls and verdicts are written down in one go;
        # a text that led to an entity is not needed any more.
        spread = frontier.repartition(width, "doc_id", "chunk_index", "path")
        called = spread.withColumn("call", call(F.col("tier"), prompt))
        found = called.withColumn("verdict", F.when(F.col("call.status") == REPLY, verdict))
        judged = work.materialize(
            found.select(
                *[c for c in carried if c != "text"], F.when(F.col("verdict.content").isNull(), F.col("text")).alias("text"),
                F.col("call.status").alias("call_status"), F.col("call.attempts").alias("attempts"),
                F.get(name_of, F.col("tier")).alias("provider"),
                F.coalesce("verdict.reject", "call.status").alias("detail"), F.col("verdict.content").alias("content"),
            ),
            "judged",
        )
        tried.append(judged.select("doc_id", "chunk_index", "path", "attempts"))

        too_large = F.col("call_status") == TOO_LARGE
        deepest = F.size("path") >= config.max_chunk_splits
        last_tier = F.col("tier") + 1 >= len(active)
        good = (F.col("call_status") == REPLY) & F.col("content").isNotNull()
        passed_on = ~good & ~too_large
        leaves.append(leaf(judged.filter(good), ENTITY, F.lit(None).cast("string")))
        leaves.append(leaf(judged.filter(too_large & deepest), FAILURE, F.lit(STILL_TOO_LARGE)))
        leaves.append(leaf(judged.filter(passed_on & last_tier), FAILURE, F.lit(ALL_FAILED)))

        next_tier = judged.filter(passed_on & ~last_tier).withColumn("tier", F.col("tier") + 1).select(*carried)
        halves = judged.filter(too_large & ~deepest).select(
            *[c for c in carried if c != "text"], F.posexplode(midpoint_halves(F.col("text"))).alias("half", "text")
        )
        halves = halves.select(
            *[c for c in carried if c not in ("path", "sub_index", "tier", "text")],
            F.concat("path", F.array("half")).alias("path"),
            (F.col("sub_index") * 10 + F.col("half")).alias("sub_index"),
            F.lit(0).alias("tier"), "text",
        )
        frontier = next_tier.unionByName(halves)
        if frontier.isEmpty():
            return leaves, tried
