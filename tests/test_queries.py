"""Every core query that has SQL against DuckDB, on the smallest tables."""

import compare
import pytest

from karstflow.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return compare.connection(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, con, sf, name):
    assert compare.from_spark(registry.QUERIES[name](spark, sf)) == compare.from_duckdb(con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_have_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "comm"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _plan(spark, df):
    short = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", short)
    return plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    from bench import copart
    from karstflow.plans.queries import cobuyers

    plan = _plan(spark, copart(spark, sf))
    assert "EqualTo(l_returnflag,R)" in plan and "EqualTo(l_linestatus,F)" in plan
    assert "l_extendedprice" not in plan
    plan = _plan(spark, cobuyers(spark, sf))
    assert "l_suppkey" in plan and "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_the_graph_is_of_all_rows(spark, con, sf):
    """No order or line item is left out of the queries' graph."""
    from karstflow.plans.queries import pairs

    sizes = "select sum(n * n) from (select count(*) as n from lineitem join orders on o_orderkey = l_orderkey group by l_partkey, l_suppkey)"
    assert pairs(spark, sf).count() == con.execute(sizes).fetchone()[0]
    assert con.execute("select count(*) from lineitem anti join orders on o_orderkey = l_orderkey").fetchone()[0] == 0
