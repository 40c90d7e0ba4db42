"""Plan shape: pushed filters, pruned columns, no Python and no cross join on the hot paths."""

import pytest

import __spark_entry__ as entry
from skyloom.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
JVM_ONLY = [n for n in sorted(catalog.QUERIES) if not n.startswith("stream_")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_pair_of_everything(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(entry.queries()[name](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "MapInPandas" not in plan and "ArrowEvalPython" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(entry.queries()["track_segments"](spark, SF_DIR))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint" in plan
    assert "props" not in plan


def test_box_filter_reaches_the_store(spark, tmp_path):
    from skyloom.plans.adapters import adapt
    from skyloom.sources import store

    store.publish(spark, str(tmp_path), 1, {"fixes": adapt(spark, SF_DIR, "sites")})
    plan = plan_of(store.load_in_box(spark, str(tmp_path), "fixes", 20, 25, -100, -95))
    assert "PushedFilters: [IsNotNull(lat)" in plan and "PartitionFilters: [" in plan
    assert "tile" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_first_wins_prunes_before_the_shuffle(spark):
    plan = plan_of(entry.queries()["navaid_name_dedup"](spark, SF_DIR))
    assert "WindowGroupLimit" in plan
