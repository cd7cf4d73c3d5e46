"""Every registered query against its DuckDB statement at the smallest scale, and a look at its plan."""

import duckdb
import pytest

import workload.all  # noqa: F401
from tools.check_oracle import TABLES, rows_of
from workload.registry import COVERS, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert COVERS[name]
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_few_queries_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == {"approximate_neighbours"}
