"""Every registered query against its SQL on DuckDB, as sorted rows with a small tolerance."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SF = os.environ.get("TIDEMARK_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, (bool, str, int)):
        return x
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    try:
        return float(x)
    except (TypeError, ValueError):
        return str(x)


def key(row):
    return [("" if x is None else f"{x:.3e}" if isinstance(x, float) else str(x)) for x in row]


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-7, abs_tol=1.1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(([plain(r[c]) for c in names] for r in got.collect()), key=key)
    cursor = duck.execute(registry.oracle_sql()[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == names
    want = sorted(([plain(r[have.index(c)]) for c in names] for r in cursor.fetchall()), key=key)
    assert len(rows) == len(want) and rows
    for a, b in zip(rows, want):
        assert all(same(x, y) for x, y in zip(a, b)), (names, a, b)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
