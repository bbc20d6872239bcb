"""Every query against its SQL, as the driver compares them."""

import math
from pathlib import Path

import duckdb
import pytest

from tickloom import catalogue

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("events", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-6) or math.isnan(a) and math.isnan(b)
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, str(SF))
    rel = db.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x) if isinstance(x, float) and x != x else x if isinstance(x, (int, str)) else 0) for x in r)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    assert not bad, bad[:3]
