"""Every registered query against its DuckDB oracle (row count, names, order-free value hash)."""

import pytest

from lureline.plans.compare import compare, duck
from tests.conftest import SF_ORACLE

import __spark_entry__ as entry_mod

ORACLES = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF_ORACLE, entry_mod.queries()[name], ORACLES[name])
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["hash_match"], r


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "tasa_clic_pct" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_mod.queries())
