"""The SQL of training-data queries gives their rows on the smallest tables; each operator has one query."""

import glob
import os
import re

import duckdb
import pytest

from fumiyomi.llm.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df, found = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall()), key=key)
