"""Every query with an SQL equivalent gives the same rows on the smallest data."""

import math

import pytest

import __spark_entry__ as entry
from conftest import DATA

SQL = entry.oracle_sql()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def test_entry_points(spark):
    q = entry.queries()
    assert set(SQL) <= set(q)
    if DATA.exists():
        assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in SQL if n in entry.queries()))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    have = sorted(tuple(norm(r[c]) for c in sorted(names)) for r in got.collect())
    assert have == want
