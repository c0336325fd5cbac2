"""Every query with SQL against DuckDB on the small tables, and the driver's contract."""

import os

import __spark_entry__ as entry
import duckdb
import pytest
from strandline.plans import library

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(library.queries()))
def test_query(spark, duck, name):
    frame = library.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if sql := library.oracle_sql().get(name):
        cursor = duck.execute(sql)
        names = [x[0] for x in cursor.description]
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
        assert got == want and sorted(names) == columns


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(library.queries()) <= set(entry.queries())
    if os.path.isdir(FOLDER):
        assert entry.entry(spark).columns == ["id", "n"]
