"""Every query with an oracle gives the oracle's rows, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = {n: q for part in entry.PLANS for n, q in part.QUERIES.items()}
ORACLE = {n: q for part in entry.PLANS for n, q in part.ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SF), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.count() > 0 and frame.columns


def test_entry(spark):
    assert entry.entry(spark).count() == 3
