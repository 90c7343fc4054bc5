"""Registered queries beside their SQL on the smallest tables; the big runs only at larger scales."""

import os

import pytest

from checks import oracles, queries
from checks.compare import spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(queries.registered())

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_every_query_has_its_sql():
    assert set(oracles.oracle_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    df = queries.registered()[name](spark, FOLDER)
    got = spark_rows(df)
    columns, expected = sql_rows(FOLDER, oracles.oracle_sql()[name])
    assert sorted(df.columns) == columns
    assert got == expected and got
