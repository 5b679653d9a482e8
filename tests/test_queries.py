"""Every registered query against its SQL on the small tables, and the driver's contract."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from quadloom.plans.catalogue import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in frame.collect())
    assert got
    if name in ORACLE_SQL:
        run = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in run.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(str(tuple(row[i] for i in order)) for row in run.fetchall())


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
