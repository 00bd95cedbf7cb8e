"""Every query of the registry runs, and agrees with its SQL twin in DuckDB."""

import decimal

import duckdb
import pytest

from quern.catalog import TABLES
from quern.plans.registry import ORACLES, QUERIES


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(found, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


SLOW = {"model_comparison", "cross_validation"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = df.collect()
    assert df.columns
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(found, df.columns) == rows(want.fetchall(), names)


def test_tables_are_joined_and_sorted(spark, sf, duck):
    count = lambda sql: duck.execute(sql).fetchone()[0]
    joined = {r.id for r in QUERIES["full_outer_join"](spark, sf).collect()}
    assert len(joined) == count("SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings)")
    found = [tuple(r) for r in QUERIES["nulls_last_sort"](spark, sf).collect()]
    assert found == duck.execute(ORACLES["nulls_last_sort"]).fetchall() and len(found) == count("SELECT count(*) FROM documents")
    types = [r.type for r in QUERIES["placeholder_nodes"](spark, sf).collect()]
    assert types.count("unknown") > 0 and len(types) - types.count("unknown") == count("SELECT count(*) FROM part")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
