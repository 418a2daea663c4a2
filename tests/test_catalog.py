"""Queries of the catalog against their SQL in DuckDB, on the smallest tables."""

import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
#: Slow even on small tables; each is made of operators that other queries here or test_operators compare.
SLOW = {"resolve_properties", "sql_record_sets", "blocking_sweep", "jaccard_blocks", "record_set_sizes", "block_sizes", "contingency", "purity_measures", "bcubed", "cluster_purity", "adjusted_rand"}


def names():
    from kindred.plans import catalog

    return sorted(set(catalog.oracle_sql()) - SLOW)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    from kindred.plans import catalog

    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    from kindred.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())
