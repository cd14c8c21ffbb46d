"""Every query with a SQL twin is compared with DuckDB at the smallest scale; the others must run."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from corpusmill.plans.registry import TABLES

SF = "/root/testdata/sf0.001"
# twins written for one level of detail that only the larger scales have
QUERIES, SQL = entry.queries(), entry.oracle_sql()
SLOW = {"navigation_recall", "beam_descent", "sound_pruning", "catalog_integrity"}


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if isinstance(v, dt.datetime) else str(v)


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n in SQL and n not in SLOW])
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    ours = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    theirs = sorted(tuple(norm(v) for v in r) for r in rel.fetchall())
    assert ours == theirs
