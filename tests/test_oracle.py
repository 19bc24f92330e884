"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as E
from gridload.sources.tables import TABLES
from tools.check_oracle import rows_of

ORACLE = E.oracle_sql()
NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, small_dir, name):
    sdf = E.queries()[name](spark, small_dir)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    res = con.execute(ORACLE[name])
    dcols = [c[0] for c in res.description]
    drows = [dict(zip(dcols, r)) for r in res.fetchall()]
    assert sorted(sdf.columns) == sorted(dcols)
    cols = sorted(dcols)
    assert rows_of(srows, cols) == rows_of(drows, cols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(ORACLE) <= set(qs)
