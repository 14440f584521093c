"""What the plans of the queries may and may not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tests.conftest import SMALL
from workload.registry import ORACLES

# operators whose numeric kernel is numpy inside Arrow batches, or that fit by passes
NUMERIC = re.compile(r"^(f[1-9]_|f10_|g[4-9]_|g1[0-9]_|h|c_j2|d6|d7|d9_sweep|i19_sweep|e7|e8_power_transform|i2_$)")
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


RELATIONAL = sorted(n for n in ORACLES if not NUMERIC.match(n))


@pytest.mark.parametrize("name", RELATIONAL)
def test_relational_queries_stay_in_the_engine(spark, name):
    plan = plan_of(entry_point.queries()[name](spark, SMALL))
    assert not [p for p in PYTHON if p in plan]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # a window without a partition key would sort everything in one task
    for spec in re.findall(r"windowspecdefinition\(([^()]*)", plan):
        assert not re.match(r"[\w#]+L? (ASC|DESC)", spec), spec


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(entry_point.queries()["c_p1_pivot_regret"](spark, SMALL))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"event_id:bigint,value:double"}
    plan = plan_of(entry_point.queries()["i16_comparison"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan


def test_texts_are_not_shuffled(spark):
    from workload.fixtures import document_features

    plan = plan_of(document_features(spark, SMALL))
    below_join = plan[plan.index("Join") :]
    for line in below_join.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "text" not in line


def test_holdout_is_a_narrow_expression(spark):
    from pipegrid.operators.split import holdout_fraction

    plan = plan_of(holdout_fraction(spark.range(1000).withColumnRenamed("id", "row_id"), 0.33, 1))
    assert "Exchange" not in plan and "Window" not in plan


def test_a_view_of_a_cache_is_not_cached_again(spark):
    from pipegrid.session import held, hold

    base = hold(spark.range(10).withColumn("x", F.rand(1)))
    view = base.filter("id > 3").select("x")
    with held(view) as rows:
        assert not rows.storageLevel.useMemory
    with held(base.groupBy("id").count()) as rows:
        assert rows.storageLevel.useMemory
    base.unpersist()
