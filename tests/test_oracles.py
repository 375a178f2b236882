"""Every registered query of the core engine against its SQL, over the smallest tables."""

import datetime as dt
import os
from decimal import Decimal

import duckdb
import pytest

from prepweave import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        return float(f"{float(value):.9g}")
    if isinstance(value, dt.datetime) and value.time() == dt.time(0):
        return value.date()
    return value


def _rows(rows):
    return sorted(repr([_plain(x) for x in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in [*TABLES.split(), "documents", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(name, spark, duck):
    found = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert _rows(found.select(*[f"`{c}`" for c in columns]).collect()) == _rows(want.fetchall())
