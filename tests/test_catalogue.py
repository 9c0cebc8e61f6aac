from __future__ import annotations

import functools

import duckdb
import pytest

from graphloom.plans import ORACLE_SQL, QUERIES, catalogue, sweeps
from graphloom.sources.views import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shared_graphs():
    """Queries over one view share its components here, and those over all pairs their sweep, to save time; each query makes its own otherwise."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(catalogue, "Graph", functools.cache(catalogue.Graph))
        patch.setattr(sweeps, "_swept", functools.cache(sweeps._swept))
        yield


def _norm(rows):
    return sorted(repr(tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in (*TABLES, "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    found = con.execute(ORACLE_SQL[name])
    at = [x[0] for x in found.description]
    assert sorted(at) == columns
    assert _norm(tuple(r) for r in df.select(*columns).collect()) == _norm(tuple(r[at.index(c)] for c in columns) for r in found.fetchall())
