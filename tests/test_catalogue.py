import pytest
from oracle import connection, same

from tabulon.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    same(catalogue.QUERIES[name](spark, sf_dir), duck, catalogue.ORACLES[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_plans_push_down_and_prune(spark, sf_dir):
    from pyspark.sql import functions as F

    t = catalogue.lines(spark, sf_dir).where(F.col("l_quantity") > 40).select("l_orderkey")
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "l_tax" not in plan
