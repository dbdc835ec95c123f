"""Page fetch with escalation to a browser, and repository star lookup.

The I/O itself is injected: ``http(url)`` and ``browser(url)`` return ``(status, html)``
and may raise.  Politeness comes from the layout: a lane fetches one page at a time, retries and escalation
included; the job has ``concurrency`` lanes, and the pages of a domain lie in at most ``per_domain`` of them.  Lanes
are dealt by load: the largest units first, each to the lane with the least pages so far.
"""

from __future__ import annotations

import heapq
import time
from dataclasses import dataclass
from random import uniform
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.http import CHALLENGE_MARKERS
from ..functions.urls import netloc, owner_repo
from ..session import Workspace

_RESULT = T.StructType(
    [
        T.StructField("status", T.IntegerType()),
        T.StructField("html", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("elapsed_ms", T.DoubleType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("http_attempts", T.IntegerType()),
        T.StructField(
            "attempts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("strategy", T.StringType()),
                        T.StructField("status", T.IntegerType()),
                        T.StructField("elapsed_ms", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)
# A domain with more than this part of a lane's even share is dealt by itself.
LARGE_DOMAIN = 0.01
BUCKETS_A_LANE = 64
# Pages per frame on their way back from a worker.
_FRAME_PAGES = 50


@dataclass(frozen=True)
class FetchConfig:
    concurrency: int = 20
    per_domain: int = 4
    max_retries: int = 3
    base_backoff_seconds: float = 1.0
    timeout_seconds: float | None = 30.0  # of one request; a slower one counts as failed
    sleep: Callable[[float], None] = time.sleep


class _Limited:
    """Calls with a time limit; one that comes late is left to its thread and not looked at."""

    def __init__(self, seconds: float | None):
        self.seconds, self.pool = seconds, ThreadPoolExecutor(1)

    def __call__(self, get: Callable[..., tuple[int, str]], args: tuple) -> tuple[int, str, float]:
        start = time.monotonic()
        call = self.pool.submit(get, *args)
        try:
            status, html = call.result(timeout=self.seconds)
        except FutureTimeout:
            self.pool.shutdown(wait=False)
            self.pool = ThreadPoolExecutor(1)
            raise
        return status, html or "", (time.monotonic() - start) * 1000


def _fetch_one(args: tuple, http, browser, config: FetchConfig, timed: _Limited) -> dict:
    attempts, status, html, elapsed = 0, 0, "", 0.0
    log: list[dict] = []

    def outcome(strategy: str, success: bool) -> dict:
        return dict(
            status=status, html=html, strategy=strategy, elapsed_ms=elapsed, success=success, http_attempts=attempts, attempts=log
        )

    while attempts < config.max_retries:
        attempts += 1
        try:
            status, html, elapsed = timed(http, args)
        except Exception:
            status, html, elapsed = 0, "", 0.0
        log.append({"strategy": "http", "status": status, "elapsed_ms": elapsed})
        marked = any(m in html.lower() for m in CHALLENGE_MARKERS)
        if status == 200 and not marked:
            return outcome("http", True)
        if status not in (429, 0):
            break
        delay = config.base_backoff_seconds
        config.sleep(delay * 2 ** (attempts - 1) + uniform(0, delay))
    try:
        if browser is None:
            raise RuntimeError("no browser")
        seen, page, took = timed(browser, args)
    except Exception:
        if browser is not None:
            log.append({"strategy": "browser", "status": 0, "elapsed_ms": 0.0})
        return outcome("http" if attempts else "browser", False)
    status, html, elapsed = seen, page, took
    log.append({"strategy": "browser", "status": status, "elapsed_ms": elapsed})
    return outcome("browser", status == 200)


def assign_lanes(units: list[tuple[str, int, int]], lanes: int) -> list[int]:
    """The lane of each (name, place, pages): longest first onto the least loaded lane."""
    loads = [(0, lane) for lane in range(lanes)]
    chosen = [0] * len(units)
    for k in sorted(range(len(units)), key=lambda k: (-units[k][2], units[k][0], units[k][1])):
        load, lane = heapq.heappop(loads)
        chosen[k] = lane
        heapq.heappush(loads, (load + units[k][2], lane))
    return chosen


def with_lane(urls: DataFrame, config: FetchConfig, url_col: str = "url", out: str = "_lane") -> DataFrame:
    """Adds the lane of each page.

    Units of work are slices of large domains and buckets of small ones, a bounded number of each: a domain is large
    with more than a hundredth of a lane's even share, and is cut to `per_domain` slices at most.
    """
    lanes, url = config.concurrency, F.col(url_col)
    keyed = urls.withColumn("_domain", F.coalesce(netloc(url), F.lit("")))
    counts = keyed.groupBy("_domain").agg(F.count(F.lit(1)).alias("pages"))
    counts = Workspace(urls.sparkSession).materialize(counts, "domains")
    total = counts.agg(F.sum("pages")).first()[0] or 0
    share = max(1.0, total / lanes)
    large = counts.filter(F.col("pages") > share * LARGE_DOMAIN)
    bucket = F.pmod(F.xxhash64("_domain"), F.lit(lanes * BUCKETS_A_LANE))
    slices = F.least(F.lit(config.per_domain), F.ceil(F.col("pages") / (share * LARGE_DOMAIN))).cast("long")
    big = [(r["_domain"], r["pages"], r["slices"]) for r in large.select("_domain", "pages", slices.alias("slices")).collect()]
    small = counts.join(large, "_domain", "left_anti").groupBy(bucket.alias("bucket")).agg(F.sum("pages").alias("pages")).collect()
    units = [(d, s, -(-pages // n)) for d, pages, n in big for s in range(n)]
    units += [("", r["bucket"], r["pages"]) for r in small]
    placed = [(d, s, n, lane) for (d, s, n), lane in zip(units, assign_lanes(units, lanes), strict=True)]
    table = urls.sparkSession.createDataFrame(placed, "_unit string, _place long, _pages long, _lane int").drop("_pages")
    cut = urls.sparkSession.createDataFrame([(d, n) for d, _, n in big], "_domain string, _slices long")
    known = keyed.join(F.broadcast(cut), "_domain", "left")  # at most lanes / LARGE_DOMAIN rows
    is_big = F.col("_slices").isNotNull()
    known = known.withColumns(
        {
            "_unit": F.when(is_big, F.col("_domain")).otherwise(""),
            "_place": F.when(is_big, F.pmod(F.xxhash64(url), F.col("_slices"))).otherwise(bucket),
        }
    )
    placed_rows = known.join(F.broadcast(table), ["_unit", "_place"], "left")
    return placed_rows.select(*[F.col(f"`{c}`") for c in urls.columns], F.coalesce("_lane", F.lit(0)).alias(out))


def fetch_pages(
    urls: DataFrame,
    http: Callable[..., tuple[int, str]],
    browser: Callable[..., tuple[int, str]] | None = None,
    config: FetchConfig = FetchConfig(),
    url_col: str = "url",
    more: tuple[str, ...] = (),
    done: DataFrame | None = None,
) -> DataFrame:
    """Add status, html, strategy, elapsed_ms, success, http_attempts and the log of attempts to every URL row.

    ``more`` names columns that are handed to the callables after the URL.  ``done`` is an earlier result: its successful
    pages are not fetched again but returned as they are.  The pages are written down before they are
    returned: reading the result twice does not fetch twice, and a lost executor repeats no finished task.
    """
    schema = T.StructType([*urls.schema.fields, *_RESULT.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        timed = _Limited(config.timeout_seconds)
        for batch in batches:
            for start in range(0, len(batch), _FRAME_PAGES):
                part = batch.iloc[start : start + _FRAME_PAGES].reset_index(drop=True)
                args = zip(*[part[c] for c in (url_col, *more)], strict=True)
                pages = pd.DataFrame([_fetch_one(a, http, browser, config, timed) for a in args])
                yield pd.concat([part, pages], axis=1)
        timed.pool.shutdown(wait=False)

    kept = None if done is None else done.filter("success").dropDuplicates([url_col])
    todo = urls if kept is None else urls.join(kept.select(url_col), url_col, "left_anti").select(*urls.columns)
    lanes = with_lane(todo, config, url_col).repartitionById(config.concurrency, F.col("_lane")).drop("_lane")
    fetched = Workspace(urls.sparkSession).materialize(lanes.mapInPandas(run, schema), "fetched")
    if kept is None:
        return fetched
    results = kept.select(url_col, *[f.name for f in _RESULT.fields])
    return fetched.unionByName(urls.join(results, url_col).select(*fetched.columns))


def fetch_log(fetched: DataFrame, url_col: str = "url") -> DataFrame:
    """One row per attempt, in order."""
    attempts = fetched.select(url_col, F.posexplode("attempts").alias("_place", "a"))
    return attempts.select(url_col, (F.col("_place") + 1).alias("attempt"), "a.*")


def with_repository_key(papers: DataFrame, url_col: str, key: str = "_repo") -> DataFrame:
    """``owner/repo`` of each row; rows without one get scattered keys that match nothing."""
    repo = owner_repo(F.col(url_col))
    scattered = F.concat(F.lit("\u0000"), F.xxhash64(*papers.columns).cast("string"))
    return papers.withColumn(key, F.coalesce(F.concat(repo["owner"], F.lit("/"), repo["repo"]), scattered))


def enrich_stars(papers: DataFrame, stars: DataFrame, url_col: str = "github_url", out: str = "github_stars") -> DataFrame:
    """Left join with a snapshot ``(owner, repo, stars)``; an unknown repository gives null."""
    snapshot = stars.select(F.concat("owner", F.lit("/"), "repo").alias("_repo"), F.col("stars").alias(out))
    columns = [c for c in papers.columns if c != out]
    return with_repository_key(papers.select(*columns), url_col).join(snapshot, "_repo", "left").drop("_repo")


def look_up_stars(
    papers: DataFrame, lookup: Callable[[str, str], int | None], url_col: str = "github_url"
) -> DataFrame:
    """A star snapshot from an injected lookup, called once per distinct repository."""

    @F.pandas_udf(T.LongType())
    def stars(owner: pd.Series, repo: pd.Series) -> pd.Series:
        def safe(o: str, r: str) -> int | None:
            try:
                return lookup(o, r)
            except Exception:
                return None

        return pd.Series([safe(o, r) for o, r in zip(owner, repo)], dtype="Int64")

    repos = papers.select(owner_repo(F.col(url_col)).alias("r")).filter("r IS NOT NULL").select("r.*").distinct()
    return repos.withColumn("stars", stars.asNondeterministic()("owner", "repo"))


