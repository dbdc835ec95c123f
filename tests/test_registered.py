"""Every registered query on the smallest tables against its SQL yardstick."""

import pytest
from check_oracle import compare, duck

import __spark_entry__ as entry
from millrace.plans.registered import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
# Variants of a resolution or build that other entries cover; the checker script runs all.
REPEATS = {"new_entities", "mapping_log", "build_startups", "build_products", "startup_edges", "extract_entities", "dead_letters"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in REPEATS])
def test_matches_sql(spark, con, name):
    ok, message, _, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "n_chunks", "n_tokens", "longest"] and df.count() > 0
