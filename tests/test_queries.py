"""Every query that has SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

from textloom import queries

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def test_each_query_has_sql():
    assert queries.QUERIES.keys() == queries.ORACLES.keys()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in found.fetchall()), key=repr)
    assert got == want
