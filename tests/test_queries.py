"""All queries with SQL, held against DuckDB on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = Path("/root/testdata/sf0.001")


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: float(x) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x
    return sorted((tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    wanted = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    found = contract.queries()[name](spark, str(FOLDER))
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, wanted.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
