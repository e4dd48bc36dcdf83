import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import assert_same, database  # noqa: E402

from weirgate.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, con, name):
    assert_same(spark, con, SF, Q.queries()[name], Q.ORACLE[name])


def test_all_are_registered():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{i}" for i in range(1, 14)]
