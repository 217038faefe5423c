"""Every registered query that has SQL gives the SQL's rows on the smallest tables; plans hold no Python and no cartesian product."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from trailweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return made


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v + 0.0:.9g}"
    return v


def _rows(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.QUERIES.items() if sql])
def test_query_equals_its_sql(spark, data, duck, name):
    query, sql = registry.QUERIES[name]
    df = query(spark, data)
    names = sorted(df.columns)
    cursor = duck.execute(sql)
    told = [c[0] for c in cursor.description]
    assert sorted(told) == names
    at = [told.index(c) for c in names]
    assert _rows(df.select(*names).collect()) == _rows([r[i] for i in at] for r in cursor.fetchall())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_plans_stay_in_the_engine(spark, data, name):
    plan = registry.QUERIES[name][0](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "Join Cross" not in plan


#: Queries whose physical plan may hold a nested loop, and the side of it that no input makes longer.
BOUNDED_LOOPS = {"unused_squares": "the grid's 8 rows", "manifest_json": "three layers", "dictionary_subset": "one default dictionary"}


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_physical_plans_join_by_keys(spark, data, name):
    plan = registry.QUERIES[name][0](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert ("BroadcastNestedLoopJoin" in plan) <= (name in BOUNDED_LOOPS)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
