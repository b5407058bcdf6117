"""Every query of the catalog gives rows, those of its SQL where it has one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracklane import catalog

SF = "/root/testdata/sf0.001"
#: Queries whose rows are few at the smallest scale.
LARGER = {"crowded_periods": "/root/testdata/sf0.01"}


def _plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    folder = LARGER.get(name, SF)
    df = entry.queries()[name](spark, folder)
    got, columns = df.collect(), sorted(df.columns)
    assert got
    if name in catalog.ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
        want = con.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
        assert sorted(repr([_plain(r[c]) for c in columns]) for r in got) == sorted(repr([_plain(r[c]) for c in columns]) for r in rows)


def test_the_flagship_gives_rows(spark):
    assert entry.entry(spark).count() > 0
