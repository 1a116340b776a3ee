import glob
import os

import duckdb
import pytest

from maskframe.plans import oracle, queries
from maskframe.sources import synthetic

SF = "/root/testdata/sf0.01"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(r[k] if not isinstance(r[k], float) else r[k] + 0.0 for k in order) for r in found), key=str)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_its_sql(spark, duck, key):
    df = queries.queries()[key](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(SQL[key])
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1] and got[1]


def test_rows_only(spark):
    crops = queries._crops(spark, SF)[1]
    got = crops.collect()
    assert len(got) == 4 * 500 and all(0 <= r["top"] <= 4 and 0 <= r["left"] <= 4 for r in got) and 0.3 < sum(r["positive"] for r in got) / len(got) < 0.9
    assert sorted(map(str, crops.repartition(3).collect())) == sorted(map(str, got))
    frames = synthetic.frames(spark, 12, 96).collect()
    assert len({r["stem"] for r in frames}) == 12 and {r["annotator"] for r in frames} == {"A1", "A2", "A3"}


def test_grid_keeps_instances_in_their_tasks(spark):
    """Nothing but the settings' table comes to the driver, and no instance is copied for each configuration and rater."""
    plan = queries.grid_tune(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("BroadcastExchange") <= 1 and "Generate" not in plan
