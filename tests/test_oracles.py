"""Every query of the catalogue against its SQL on DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from scenemill.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return tuple(map(value, x)) if isinstance(x, list | tuple) else x


def ordered(rows):
    return sorted((tuple(map(value, r)) for r in rows), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = ordered(got.select(*columns).collect())
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = ordered([[r[names.index(c)] for c in columns] for r in found.fetchall()])
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5) for x, y in zip(a, b)), (a, b)


def test_entry_is_registered():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
