"""Every registered curation query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from corpuslab.plans import catalog

TABLES = "documents embeddings pages labels benchmark".split()
#: Rules that find nothing in the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return repr(v) if isinstance(v, float) else None if v is None else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    found = rows(df.columns, df.collect())
    assert found or name in MAY_BE_EMPTY
    if name in catalog.oracle_sql():
        rel = duck.sql(catalog.oracle_sql()[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert found == rows(list(rel.columns), rel.fetchall())
