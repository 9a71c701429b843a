"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from scriptmend.plans import catalog

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = Path(SMALL, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5)
    return round(float(value), 5) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr)
    spark.catalog.clearCache()
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert got
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert got == want
