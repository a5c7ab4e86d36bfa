"""Oracle layer: every registered query against its DuckDB twin on the smallest tables.

Same comparison as the driver: columns sorted by name, rows compared as an
order-insensitive multiset, doubles to 6 decimals.
"""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from conftest import SF_SMALL  # noqa: E402

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as E  # noqa: E402
from ohmflow.plans import registry  # noqa: E402
from oracle_check import TABLES, canon  # noqa: E402

registry.load_all()
SQL = dict(registry.ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    sc, sr = canon(df.columns, srows)
    dc, dr = canon(dcols, cur.fetchall())
    assert sc == dc
    assert sr == dr


def test_every_query_has_rows_or_oracle(spark):
    names = set(registry.QUERIES)
    assert len(names) >= 70
    assert names == set(SQL)
