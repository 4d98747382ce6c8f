"""Every registered query: equal to its SQL, or at least runnable with rows."""

import os

import pytest
from compare import database, differences

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
# Model fits on the smallest tables may have too few rows; they have tests of their own.
FITTED = {
    "forecast_facts", "forecast_board_facts",
    "rf_forecast", "gbt_forecast", "feature_importance", "multi_horizon", "sequence_forecast",
    "rolling_backtest", "forecast_board",
}


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(set(SQL) - FITTED))
def test_equals_sql(spark, small, con, name):
    assert differences(QUERIES[name](spark, small), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(SQL) & FITTED))
def test_fitted_equals_sql(spark, name):
    """Where fits need more rows than the smallest tables have."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    assert differences(QUERIES[name](spark, folder), database(folder), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - FITTED))
def test_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_oracles_name_known_queries():
    assert set(SQL) <= set(QUERIES)
