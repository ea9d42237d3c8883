"""What the plans must look like."""

from pyspark.sql import functions as F

from ringsift.operators import stats
from ringsift.queries import QUERIES
from ringsift.queries.bindings import Tables

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_the_needed_columns(spark):
    plan = _plan(stats.prefix_risk(Tables(spark, FOLDER).labeled))
    assert "l_suppkey" in plan and "l_extendedprice" not in plan and "l_shipdate" not in plan


def test_range_lookup_is_an_equi_join(spark):
    plan = _plan(QUERIES["jn01_numbering_lookup"](spark, FOLDER))
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark):
    t = Tables(spark, FOLDER)
    plan = _plan(t.base("orders").filter(F.col("o_orderkey") > 10).select("o_custkey"))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in plan


def test_no_query_pairs_events(spark):
    for name in ("jn17_callbacks", "jn22_recent_apps", "wn16_call_frequency", "wn17_prefix_calls", "ft06_device_features"):
        plan = _plan(QUERIES[name](spark, FOLDER))
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_splits_do_not_shuffle_the_rows(spark):
    plan = _plan(QUERIES["wn06_stratified_split"](spark, FOLDER))
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
