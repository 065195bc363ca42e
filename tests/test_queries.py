"""Every query against its SQL on the driver's tables."""

import datetime as dt
import decimal
import math

import pytest

from docengine import queries


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 4)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(name, spark, sf, duck):
    made = queries.QUERIES[name](spark, sf)
    got = rows(made.columns, made.collect())
    assert name in queries.ORACLE_SQL
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(made.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["upsert_replace", "delete_many"])
def test_writes_go_through_the_store(name, spark, sf, monkeypatch):
    from docengine.sources.store import Collection

    called, what = [], name.split("_")[0]
    real = getattr(Collection, what)
    monkeypatch.setattr(Collection, what, lambda self, *a, **b: called.append(what) or real(self, *a, **b))
    queries.QUERIES[name](spark, sf)
    assert called[-1:] == [what]
