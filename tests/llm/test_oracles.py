"""Queries of this folder that SQL can express, against their SQL."""

import pytest
from compare import duck, duck_rows, spark_rows

from slipway.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    names, found = spark_rows(QUERIES[name](spark, sf_dir))
    expected_names, expected = duck_rows(duck(sf_dir), ORACLES[name])
    assert names == expected_names
    assert found == expected and found
