import math

import duckdb
import pytest

from keelstone.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool) or not isinstance(v, int | float) and not hasattr(v, "as_integer_ratio"):
        return str(v)[:19] if hasattr(v, "year") else str(v)
    return f"{float(v):.5f}"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    got = sorted([plain(r[c]) for c in sorted(cols)] for r in df.collect())
    want = sorted([plain(dict(zip(cols, r))[c]) for c in sorted(cols)] for r in cur.fetchall())
    assert got == want
