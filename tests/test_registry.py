"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from tools import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in contract.oracle_sql():
        assert rows
        return
    cur = con.execute(contract.oracle_sql()[name])
    assert check.compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description]) == ""


def test_vectors_are_joined_once(spark):
    """Points meet the vector table while they are narrow, and never themselves: one join, no copy by id."""
    from checks import registry

    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert joins(registry.QUERIES["cosine_similarity"](spark, SF)) == 1
    assert joins(registry._family_points(spark, SF)) == 1
