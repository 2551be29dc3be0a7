"""Every registered query of the graph engine against SQL on the same tables."""

import math
from collections import Counter

import pytest

import __spark_entry__
from graphloom.queries import ORACLES, QUERIES


def plain(row):
    return tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in row)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_is_its_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = Counter(plain(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    at = [want.columns.index(c) for c in cols]
    assert got == Counter(plain(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["nname", "count"] and df.count() > 0
    assert set(ORACLES) == set(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
