"""Plan properties of every registered query (the scale rules, checked on the physical plan).

- no cartesian product or nested-loop join anywhere;
- no Python evaluation (row UDFs or pandas stages) in any plan: everything stays in the JVM;
- column pruning reaches the scans: the wide ``documents`` table is read as ``doc_id`` only,
  and lineitem is never read with all of its columns;
- equality filters are pushed into the Parquet scan;
- rows meet in a single partition only as partial results of a global aggregate, a limit, or an ordered
  limit;
- the model queries' input has the same properties.
"""

import os
import re

import pytest

import __spark_entry__ as entry_module
from regiopanel.plans.catalog import panel_features_frame

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in entry_module.QUERIES.items() if k not in ("ml_group_forest", "ml_predictions_long")}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _single_partition_inputs(node) -> list[str]:
    """The operators right below the exchanges to a single partition, from a physical plan."""
    found = []
    text = node.simpleString(200)
    children = [node.children().apply(i) for i in range(node.children().length())]
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        children = [node.initialPlan()]
    if "SinglePartition" in text and children:
        below = children[0]
        found.append(below.nodeName() + " " + below.simpleString(400))
    for child in children:
        found += _single_partition_inputs(child)
    return found


@pytest.mark.parametrize("name", sorted(QUERIES) + ["model input"])
def test_plan_has_no_forbidden_operator(spark, name):
    df = panel_features_frame(spark, SF) if name == "model input" else QUERIES[name](spark, SF)
    plan = _plan(df)
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"
    for below in _single_partition_inputs(df._jdf.queryExecution().executedPlan()):
        assert re.search(r"partial_|LocalLimit", below), f"{name}: whole rows go to one partition: {below}"
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        if "l_orderkey" in schema:
            assert schema.count(":") < 11, f"{name} reads every lineitem column"


def test_documents_scan_is_pruned(spark):
    plan = _plan(QUERIES["null_fill"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_equality_filter_is_pushed(spark):
    plan = _plan(QUERIES["filter_eq"](spark, SF))
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,MACHINERY)]" in plan
    scan = _plan(QUERIES["io_collection_scan"](spark, SF))
    assert "EqualTo(c_mktsegment,BUILDING)" in scan and "TakeOrderedAndProject" in scan


def test_topk_limits_before_the_shuffle(spark):
    plan = _plan(QUERIES["topk_per_group"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_partitioned_collection_query_prunes(spark):
    plan = _plan(QUERIES["io_collection_partitioned_scan"](spark, SF))
    assert "PartitionFilters: [isnotnull(c_mktsegment" in plan and "AUTOMOBILE" in plan
