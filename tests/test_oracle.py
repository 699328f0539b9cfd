"""Every registered query against its SQL statement, over whole tables."""

import pytest

from tests.compare import check, connect
from trialframe.catalog import ORACLES, QUERIES
from trialframe.plans.ordered import CAP_CONF


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    _, problem = check(spark, duck, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert problem is None, problem


@pytest.mark.parametrize(
    "name",
    ["spearman_by_brand", "gains_curve_by_type", "run_segments", "interpolated_curves", "global_rank_of_prices",
     "hypervolume_by_generation", "padded_gain_curves", "exact_percentiles_by_brand"],
)
def test_query_matches_sql_when_every_group_is_oversized(spark, duck, sf_dir, name):
    spark.conf.set(CAP_CONF, "40")
    try:
        _, problem = check(spark, duck, name, QUERIES[name], ORACLES.get(name), sf_dir)
    finally:
        spark.conf.unset(CAP_CONF)
    assert problem is None, problem


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
