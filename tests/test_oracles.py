"""Every registered query against its SQL oracle on the smallest data set."""

from __future__ import annotations

import pytest

from epispark.plans import REGISTRY
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, sf, con, name):
    q = REGISTRY[name]
    df = q.build(spark, sf)
    if q.oracle is None:
        assert df.count() > 0
        return
    assert compare(df, con, q.oracle) == ""


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
