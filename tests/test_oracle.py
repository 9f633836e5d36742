"""Every registered query against its DuckDB oracle (or a rows-only run) on sf0.001."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from sparklog.plans.catalog import load_all
from tests.oracle_check import compare, duck

QUERIES = {k: v for k, v in E.queries().items() if k in load_all()[0]}
ORACLES = load_all()[1]


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf_small, con, name):
    r = compare(spark, sf_small, name, QUERIES[name], ORACLES[name], con)
    assert r["cols"], (r["spark_cols"], r["duck_cols"])
    assert r["rows"], (r["n_spark"], r["n_duck"])
    assert r["values"], (r["sample_spark"], r["sample_duck"])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    assert df.count() >= 0


def test_every_query_has_an_id_prefix():
    for name in QUERIES:
        assert name.split("_")[0][0] in "safjxdwlugtpk", name


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"log_id", "anomaly_score", "severity"}
    assert df.count() > 0
