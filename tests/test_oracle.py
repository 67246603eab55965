"""Every catalog query against the same query in DuckDB, on the smallest supplied tables."""

import glob
import math
import os

import duckdb
import pytest

from engram.plans import catalog, catalog_index, catalog_jobs, catalog_more, catalog_paths, catalog_rest, catalog_rules  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return None if math.isnan(float(v)) else round(float(v), 4)
    return str(v)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = table([tuple(r) for r in df.collect()], df.columns)
    if name not in catalog.SQL:
        assert got[0]
        return
    c = duck.execute(catalog.SQL[name])
    assert got == table(c.fetchall(), [d[0] for d in c.description])
