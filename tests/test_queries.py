import pytest
from oracle import assert_same, database

import __spark_entry__
from weirgate.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert_same(spark, con, SF, plans.QUERIES[name], plans.ORACLES[name])


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 1 and rows[0].safe == max(0, rows[0].total - rows[0].blocked - rows[0].bypassed)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    from weirgate.operators import log_analytics as A

    plan = A.kpi_summary(plans.logs(spark, SF), plans.DAY_OF, 24)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "props" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[-1]
