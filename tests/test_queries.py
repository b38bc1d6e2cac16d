"""Every registered query against its SQL on the smallest tables."""

import pytest

from corpusflow.queries import load
from corpusflow.queries.compare import canonical, connect, oracle_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = canonical(df.columns, df.collect())
    if name in ORACLES:
        assert got == oracle_rows(con, ORACLES[name])
    else:
        assert got[1]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
