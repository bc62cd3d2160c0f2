"""Every reference query against its SQL in DuckDB, on the smallest driver tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lectern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.columns, rows) == table(want.columns, want.fetchall())


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())


def test_plan_shapes(spark):
    q = registry.queries()
    plan = lambda name: q[name](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan("q_keep_first") and "TakeOrderedAndProject" in plan("q_topk")
    assert "BroadcastNestedLoopJoin" not in plan("q_or_anti") and "PushedFilters: [IsNotNull(l_linenumber), LessThan(l_linenumber,3)]" in plan("q_first_segments")


def test_prefix_map_keeps_a_long_mapping(spark):
    from lectern.operators.catalog import prefix_map

    mapping = spark.range(10_050).selectExpr("concat('p', id, '-') AS prefix", "id AS folder")
    rows = mapping.selectExpr("concat(prefix, 'x') AS name")
    assert prefix_map(rows.where("substr(name, 1, 4) = 'p100'"), mapping, "name", "prefix").count() == rows.where("substr(name, 1, 4) = 'p100'").count()


def test_frames_are_not_shuffled(spark):
    plan = registry.queries()["q_frames_at"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert "ShuffledHashJoin" in plan and "Generate explode" in plan
    assert len(exchanges) == 2 and all("REPARTITION_BY_COL" in line for line in exchanges)  # before any frame is told out
