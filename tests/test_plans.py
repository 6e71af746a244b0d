"""Plans stay free of nested loops and cartesian products, filters and columns reach the scan."""

import re

import pytest

from tracewright.plans import catalog
from tracewright.sources import scratch
from tracewright.sources import tables as T

SF = "/root/testdata/sf0.001"
#: Folds whose state hands on from frame to frame: one pass in order, in Python.
FOLDS = {"particle_points", "particle_paths", "particle_arcs", "evidence_shelf"}
ALL_ROWS = re.compile(r"Window \[[^\n]*\n[^\n]*(Sort [^\n]*\n[^\n]*)?Exchange SinglePartition")


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"stream_sessions"}))
def test_no_nested_loops(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert name in FOLDS or "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
    assert not ALL_ROWS.search(plan), "a window over all rows meets in one task"


@pytest.mark.parametrize("name,most", [("restitution", 3), ("contact_gating", 5), ("near_event_semi", 5), ("near_event_anti", 5), ("coherence_corr", 4), ("semantic_timeline", 10), ("report_followups", 10), ("causality_rules", 4), ("causality_severity", 4), ("effect_before_cause", 1), ("sync_reversal", 2),
    ("splash_timing", 1), ("flow_discontinuity", 2), ("incompressibility", 2), ("rank_auc", 2), ("spearman", 4), ("median_split_auc", 2), ("mean_mask_iou", 9), ("event_clip_index", 3), ("evidence_state", 3), ("smooth_short", 1), ("dilated_contact", 4), ("interpenetration", 5)])
def test_exchanges(spark, name, most):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most, plan.count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["rank_auc", "spearman", "median_split_auc"])
def test_rank_statistics_read_little(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4


def test_shared_tables_are_computed_once(spark):
    """All branches of the findings read the written tables; none goes back to the events."""
    plan = catalog.QUERIES["semantic_timeline"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and plan.count("FileScan") <= 12


@pytest.mark.parametrize("name", ["semantic_timeline", "report_followups"])
def test_what_is_sorted_by_track_or_video_is_dealt_by_rows(spark, monkeypatch, name):
    """Flights, episodes, coasts and the flow are sorted in partitions whose number follows the rows, and which are
    not joined again, so that a task's memory does not grow with the table."""
    monkeypatch.setattr(scratch, "PART_ROWS", 100)
    n = -(-T.grid(spark, SF).count() // 100)
    plan = re.sub(r"#\d+L?", "", catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert n > 4 and plan.count(f"Exchange hashpartitioning(video_id, track_id, {n}), REPARTITION_BY_NUM") == 2
    assert plan.count(f"Exchange hashpartitioning(video_id, {n}), REPARTITION_BY_NUM") == 1
    assert re.search(r"Exchange hashpartitioning\(video_id, track_a, track_b, \d+\), REPARTITION_BY_NUM", plan)


def test_pushdown(spark):
    plan = catalog.QUERIES["scan_project_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,50.0)" in plan and "props" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_pattern_sees_a_window_over_all_rows(spark):
    plan = spark.range(9).selectExpr("id", "row_number() over (order by id desc) as n")._jdf.queryExecution().executedPlan().toString()
    assert ALL_ROWS.search(plan)
