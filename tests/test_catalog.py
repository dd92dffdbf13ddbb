"""Every registered query against its SQL check, and the driver contract."""

import pytest

import __spark_entry__ as contract
import oracle

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("key", sorted(CHECKS))
def test_query_equals_sql(spark, con, key):
    assert oracle.compare(spark, con, QUERIES[key], CHECKS[key], FOLDER) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(CHECKS)))
def test_query_without_sql_returns_rows(spark, key):
    assert QUERIES[key](spark, FOLDER).limit(1).count() == 1


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry_has_prediction_columns(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["window_days", "level", "entity", "revenue_lower", "revenue_point",
                             "revenue_upper", "spend_point", "roas_lower", "roas_point", "roas_upper"]
