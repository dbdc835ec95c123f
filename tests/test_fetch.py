import sys
import time
import uuid
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.functions import http as h
from millrace.functions.urls import arxiv_month_start, netloc, owner_repo
from millrace.operators.fetch import FetchConfig, assign_lanes, enrich_stars, fetch_pages, look_up_stars, with_lane


# Workers cannot import a test module, so its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def no_wait(_):
    return None


def http(url):
    kind = url.rsplit("/", 1)[-1]
    if kind == "down":
        raise OSError("mock")
    return {"ok": (200, "<p>hi</p>"), "busy": (429, ""), "wall": (200, "Checking your browser"), "gone": (404, "no")}[kind]


def browser(url):
    if url.endswith("gone"):
        raise RuntimeError("mock")
    return 200, "<p>rendered</p>"


def test_fetch_escalates(spark):
    urls = spark.createDataFrame([(f"https://e.x/{k}",) for k in ("ok", "busy", "wall", "gone", "down")], "url string")
    rows = fetch_pages(urls, http, browser, FetchConfig(concurrency=3, sleep=no_wait)).collect()
    got = {r.url.rsplit("/", 1)[-1]: (r.status, r.strategy, r.success, r.http_attempts) for r in rows}
    assert got == {
        "ok": (200, "http", True, 1), "busy": (200, "browser", True, 3), "wall": (200, "browser", True, 1),
        "gone": (404, "http", False, 1), "down": (200, "browser", True, 3),
    }


def test_decisions(spark):
    rows = [(200, "fine", 1), (200, "via DataDome", 1), (403, "", 1), (503, "", 1), (429, "", 1), (429, "", 3), (0, "", 2), (404, "", 1), (500, None, 1)]
    df = spark.createDataFrame(rows, "s int, b string, a int").coalesce(1)
    got = df.select(h.is_blocked(F.col("s"), F.col("b")).alias("x"), h.next_action(F.col("s"), F.col("b"), F.col("a")).alias("n")).collect()
    assert [r.x for r in got] == [False, True, True, True, False, False, False, False, False]
    assert [r.n for r in got] == ["accept", "escalate", "escalate", "escalate", "retry", "escalate", "retry", "escalate", "escalate"]


def test_error_classes_and_backoff(spark):
    rows = [(200, ""), (429, ""), (413, ""), (500, ""), (400, "Context length"), (400, "bad"), (401, ""), (302, "")]
    df = spark.createDataFrame(rows, "s int, b string").coalesce(1)
    assert [r[0] for r in df.select(h.error_class(F.col("s"), F.col("b"))).collect()] == [
        None, "rate_limited", "payload_too_large", "unavailable", "payload_too_large", "http_error", "http_error", "http_error",
    ]
    steps = spark.range(1, 8).coalesce(1).select(h.provider_backoff(F.col("id")), h.fetch_backoff(F.col("id")))
    assert [tuple(r) for r in steps.collect()][:6] == [(1.5, 1.0), (3.0, 2.0), (6.0, 4.0), (12.0, 8.0), (24.0, 16.0), (30.0, 32.0)]


def test_urls_and_stars(spark):
    urls = [
        ("https://github.com/a.b/c-d.git", ("a.b", "c-d")), (" http://github.com/o/r/ ", ("o", "r")), ("github.com/o/r.git/", ("o", "r")),
        ("https://github.com/o/r/tree/main", None), ("https://github.com/o/r?x=1", None), ("https://gitlab.com/o/r", None), (None, None),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "i int, github_url string")
    got = df.select("i", owner_repo(F.col("github_url")).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) if r.r else None for r in got] == [e for _, e in urls]
    stars = look_up_stars(df, lambda owner, repo: 7 if owner == "o" else None)
    rows = enrich_stars(df, stars).orderBy("i").collect()
    assert [r.github_stars for r in rows] == [None, 7, 7, None, None, None, None]
    one = spark.createDataFrame([("https://u:p@E.x:81/p?q#f", "https://arxiv.org/abs/1907.04321")], "u string, p string")
    assert tuple(one.select(netloc(F.col("u")), arxiv_month_start(F.col("p"))).first()) == ("u:p@E.x:81", "2019-07-01T00:00:00")


def counting(folder, seconds):
    """A request that notes how many others are in flight, of its domain and of the job."""

    def get(url):
        domain, ident = url.split("/")[2], uuid.uuid4().hex
        own = Path(folder, f"{domain}~{ident}")
        own.touch()
        names = [p.name for p in Path(folder).glob("*~*")]
        Path(folder, f"seen-{ident}").write_text(f"{len(names)} {sum(n.startswith(domain + '~') for n in names)}")
        time.sleep(seconds)
        own.unlink()
        return 200, "page"

    return get


def test_requests_in_flight(spark, tmp_path):
    rows = [(f"https://{d}.x/{i}",) for d, n in (("one", 60), ("two", 20), ("three", 4)) for i in range(n)]
    urls = spark.createDataFrame(rows, "url string")
    config = FetchConfig(concurrency=6, per_domain=2)
    assert fetch_pages(urls, counting(str(tmp_path), 0.02), config=config).filter("success").count() == 84
    seen = [tuple(map(int, p.read_text().split())) for p in tmp_path.glob("seen-*")]
    assert len(seen) == 84 and max(a for a, _ in seen) <= 6 and max(d for _, d in seen) <= 2


def test_lanes_are_even_and_domains_bounded(spark):
    rows = [(f"https://{'hot' if i % 10 == 0 else f'site{i % 997}'}.x/{i}",) for i in range(20_000)]
    placed = with_lane(spark.createDataFrame(rows, "url string"), FetchConfig(concurrency=8, per_domain=4)).cache()
    loads = [r["count"] for r in placed.groupBy("_lane").count().collect()]
    assert len(loads) == 8 and max(loads) - min(loads) <= 0.1 * 2500
    lanes = placed.withColumn("d", netloc(F.col("url"))).groupBy("d").agg(F.count_distinct("_lane").alias("n"))
    assert lanes.agg(F.max("n")).first()[0] <= 4
    assert assign_lanes([("a", 0, 5), ("b", 0, 4), ("c", 0, 3), ("d", 0, 3)], 2) == [0, 1, 1, 0]
    assert with_lane(spark.createDataFrame([], "url string"), FetchConfig()).count() == 0


def slow(url):
    time.sleep(2 if "slow" in url else 0)
    return 200, "page"


def test_time_limit_and_resume(spark, tmp_path):
    urls = spark.createDataFrame([("https://e.x/slow", 1), ("https://e.x/fast", 2)], "url string, n int")
    config = FetchConfig(concurrency=2, max_retries=1, timeout_seconds=0.5, sleep=no_wait)
    first = fetch_pages(urls, slow, config=config)
    assert {r.url[12:]: (r.status, r.success) for r in first.collect()} == {"slow": (0, False), "fast": (200, True)}
    again = fetch_pages(urls, counting(str(tmp_path), 0), config=config, done=first)
    assert again.columns == first.columns and again.filter("success").count() == 2
    assert len(list(tmp_path.glob("seen-*"))) == 1
