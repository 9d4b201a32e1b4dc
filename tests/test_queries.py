"""Every query of the engine against its SQL, and the others for their shape."""

import pytest

from lexmill.plans import registry

ORACLES = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {"rule_id", "status", "n"} == set(__spark_entry__.entry(spark).columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
