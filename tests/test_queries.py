"""Every engine query against its SQL, row by row."""

import duckdb
import pytest

from tests.conftest import DATA
from tidemark.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(list(v)) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    order = sorted(got.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == order
    want = sorted("|".join(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in found.fetchall())
    assert sorted("|".join(plain(r[c]) for c in order) for r in got.collect()) == want


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
