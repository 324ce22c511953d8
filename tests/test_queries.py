"""Every query that has SQL agrees with it on the smallest tables; the others give rows of a stable schema."""

import math
import os

import duckdb
import pytest

from sparkloom.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(rows):
    return sorted((tuple(map(norm, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    if name in registry.oracle_sql():
        r = db.sql(registry.oracle_sql()[name])
        want = r.fetchall()
        at = [r.columns.index(c) for c in cols]
        assert sorted(r.columns) == cols and rows_of(rows) == rows_of([[x[i] for i in at] for x in want])
