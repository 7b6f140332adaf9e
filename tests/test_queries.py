"""Every registered query against its SQL twin, or for rows where SQL cannot state it."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, connection, name):
    assert differences(spark, connection, FOLDER, name, queries(), oracle_sql()) is None


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["model", "threshold", "class", "precision", "recall", "f1", "support"]
    assert result.count() == 2 * 4 * 5


def test_profile_sizes(spark):
    from churnlake.sources.tables import customer_profile

    profile = customer_profile(spark, FOLDER)
    assert profile.count() == 150
    assert profile.agg({"exited": "avg"}).first()[0] == pytest.approx(0.2)
