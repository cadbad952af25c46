"""Every registered query runs and, where it has SQL, equals it on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from seqloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    sql = catalog.oracles().get(name)
    if sql:
        got = db.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(names) == cols
        order = [names.index(c) for c in cols]
        assert sorted(tuple(plain(r[k]) for k in order) for r in got.fetchall()) == rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
