"""Every registered query against its SQL on DuckDB, at the smallest scale; where nothing matches there, at the next."""

import pytest

from spoor.catalog import load_all

import oracle

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def duck():
    pytest.importorskip("duckdb")
    return {sf: oracle.connect(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert name in ORACLES
    ok, message = oracle.compare(spark, duck[SF], name, QUERIES[name], ORACLES[name], SF)
    if message.startswith("EMPTY"):
        ok, message = oracle.compare(spark, duck[LARGER], name, QUERIES[name], ORACLES[name], LARGER)
    assert ok, message
