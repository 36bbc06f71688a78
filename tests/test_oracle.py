"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from corvane.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def key(row):
    return tuple((v is None, "" if isinstance(v, (int, float)) else str(type(v)), 0 if v is None else round(v, 3) if isinstance(v, float) else v) for v in row)


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(a - b) <= 2e-5 * max(1, abs(a))
    return a == b


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    got = sorted((tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=key)
    if name not in registry.ORACLE:
        assert got
        return
    res = duck.execute(registry.ORACLE[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted((tuple(value(r[i]) for i in order) for r in res.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(all(map(same, a, b)) for a, b in zip(got, want, strict=True))
