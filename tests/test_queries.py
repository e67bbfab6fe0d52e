"""Every query of the accessibility engine against its SQL, on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from waymark.plans.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    own.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return own


def plain(row) -> tuple:
    out = []
    for x in row:
        if isinstance(x, float):
            x = None if math.isnan(x) else float(f"{x:.9g}")
        out.append(float(x) if isinstance(x, (int, bool)) else x if x is None or isinstance(x, float) else str(x))
    return tuple(out)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(plain, df.select(*names).collect())) == Counter(map(plain, want.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
