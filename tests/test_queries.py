"""Every registered query against its SQL oracle on the smallest data set."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from tessera.plans.catalog import ORACLE, QUERIES


def _rows(values):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = _rows([tuple(r[c] for c in cols) for r in df.collect()])
    assert name in ORACLE
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = _rows([tuple(r[i] for i in idx) for r in rel.fetchall()])
    assert got == want


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "area" in df.columns
