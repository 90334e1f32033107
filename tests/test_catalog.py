"""Every catalogued query runs, and equals its SQL on DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from palimpsest.plans import catalog

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def flat(rows):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = flat(tuple(r) for r in df.select(*cols).collect())
    assert got
    if name in catalog.ORACLE:
        want = flat(duck.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE[name]})").fetchall())
        assert len(got) == len(want) and got == want, (got[:3], want[:3])
