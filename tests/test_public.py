"""The public interface, and reference times in other time zones."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import millrace

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", millrace.__all__)
def test_exported(name):
    assert callable(getattr(millrace, name))


def test_unknown_name():
    with pytest.raises(AttributeError):
        _ = millrace.nothing_like_this


CODE = """
import sys; sys.path.insert(0, sys.argv[1])
from datetime import datetime
from pyspark.sql import functions as F
from millrace import build_session, in_window, normalize_date
spark = build_session("zones", "local[1]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1"})
ref = datetime(2026, 9, 12, 12)
df = spark.createDataFrame([("Today",), ("2 hours ago",), ("2026-09-11T12:00:00Z",), ("2026-09-11T11:59:59Z",)], "raw string")
value = normalize_date(F.col("raw"), ref)["value"]
rows = df.select(F.date_format(value, "yyyy-MM-dd HH:mm:ss"), in_window(value, ref)).collect()
print([tuple(r) for r in rows])
"""


def test_naive_reference_time_is_utc():
    done = subprocess.run([sys.executable, "-c", CODE, str(ROOT)], env={**os.environ, "TZ": "America/New_York"}, capture_output=True, text=True, timeout=200)
    want = [("2026-09-12 12:00:00", True), ("2026-09-12 10:00:00", True), ("2026-09-11 12:00:00", True), ("2026-09-11 11:59:59", False)]
    assert done.stdout.strip().split("\n")[-1] == str(want), done.stderr[-2000:]
