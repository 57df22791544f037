"""Every registered query of the catalogue against its SQL, run by another engine on the same small tables."""

import glob
import os

import duckdb
import pytest

from framelake.plans import registry

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    text = registry.oracle_sql()[name]
    want = duck.execute(f"select {', '.join(columns)} from ({text})").fetchall()
    assert got == sorted(map(repr, want))
    kinds = {r[0]: r[1] for r in duck.execute(f"describe {text}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    # All of it stays in the JVM.
    done = df._jdf.queryExecution()
    plan = done.executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "Python" not in done.toRdd().toDebugString() and "ExistingRDD" not in plan
