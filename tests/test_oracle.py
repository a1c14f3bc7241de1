"""Every query with SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    value = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float | Decimal) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
