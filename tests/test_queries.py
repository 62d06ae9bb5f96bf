"""Every registered query against its oracle on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare

ORACLES = oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, sf, name):
    if name in ORACLES:
        assert compare(spark, con, name, queries()[name], ORACLES[name], sf) is None
    else:
        assert queries()[name](spark, sf).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    df = entry(spark)
    assert {r["split"] for r in df.collect()} == {"train", "test", "validation"}
