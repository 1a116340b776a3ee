import glob
import os

import duckdb
import pytest

from maskframe.llm import catalog

SF = "/root/testdata/sf0.01"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_its_sql(spark, key):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = catalog.queries()[key](spark, SF)
    rel = c.sql(SQL[key])
    rows = lambda names, found: sorted((tuple(round(x, 9) if isinstance(x, float) else x for _, x in sorted(zip(names, r))) for r in found), key=str)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_ten_operators():
    assert sorted(int(k[2:].split("_")[0]) for k in catalog.queries()) == list(range(1, 11))
