"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quiltnet.plans import graph_queries, registry, relational_queries, report_queries, semantic_queries, source_queries, summary_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted(str(tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    cols = sorted(df.columns)
    if name not in registry.ORACLE:
        assert got
        return
    want = duck.sql(registry.ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert plain(tuple(r[c] for c in cols) for r in got) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
