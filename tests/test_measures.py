from datetime import datetime

import pytest

from modelsift.plans.measures import SlicedState, measures
from modelsift.plans import reports

MB = 1048576


@pytest.fixture(scope="module")
def state(spark):
    f = spark.createDataFrame
    return {
        "overview": f(
            [("m1", "A", datetime(2024, 1, 1)), ("m2", "B", datetime(2024, 1, 2))],
            "semantic_model_id string, workspace_name string, analysis_completed_at timestamp",
        ),
        "opportunities": f(
            [("o1", "m1", "HIGH"), ("o2", "m2", "INFO")],
            "opportunity_id string, semantic_model_id string, highest_severity string",
        ),
        "recommendations": f([("r1", "m1"), ("r2", "m2"), ("r3", "m2")], "recommendation_id string, semantic_model_id string"),
        "findings": f(
            [
                ("f1", "m1", "ERROR", MB, 2 * MB),
                ("f1", "m1", "WARNING", None, MB),
                ("f2", "m2", "error", 3 * MB, None),
                ("f3", "m2", "CRITICAL", None, None),
            ],
            "finding_id string, semantic_model_id string, severity string, estimated_saving_bytes_low bigint, "
            "estimated_saving_bytes_high bigint",
        ),
        "column_storage": f(
            [("m1", "c", MB // 2), ("m2", "c", MB), ("m2", "d", None)],
            "semantic_model_id string, column_name string, total_size_bytes bigint",
        ),
        "opportunity_recommendation_links": f([("o1", "r1"), ("o2", "r2")], "opportunity_id string, related_entity_id string"),
        "opportunity_finding_links": f(
            [("o1", "f1"), ("o1", "f1"), ("o2", "f2")], "opportunity_id string, related_entity_id string"
        ),
    }


def test_all_measures(state):
    got = measures(state).first()
    assert got.asDict() == dict(
        models_scanned=2,
        latest_analysis_at=datetime(2024, 1, 2),
        total_opportunities=2,
        total_recommendations=3,
        columns_analyzed=3,
        total_column_storage_mb=1.5,
        total_findings=4,
        high_findings=3,  # without regard to case, as in the overview
        estimated_saving_mb_low=4.0,
        estimated_saving_mb_high=3.0,
    )


def test_high_findings_replaces_a_severity_slicer(state):
    got = measures(state, {"findings": {"severity": ["WARNING"]}}).first()
    assert (got.total_findings, got.high_findings) == (1, 3)
    got = measures(state, {"findings": {"severity": ["WARNING"]}, "overview": {"workspace_name": ["B"]}}).first()
    assert (got.total_findings, got.high_findings) == (0, 2)
    assert (got.estimated_saving_mb_low, got.models_scanned, got.total_recommendations) == (0.0, 1, 2)


def test_empty_state_gives_zeros_and_no_date(state):
    got = measures(state, {"overview": {"workspace_name": ["none"]}}).first().asDict()
    assert got.pop("latest_analysis_at") is None
    assert set(got.values()) == {0}


def test_slicers_reach_children_of_children(state):
    sliced = SlicedState(state, {"overview": {"workspace_name": ["A"]}})
    assert [r.related_entity_id for r in sliced["opportunity_recommendation_links"].collect()] == ["r1"]
    sliced = SlicedState(state, {"opportunities": {"highest_severity": ["INFO"]}})
    assert [r.related_entity_id for r in sliced["opportunity_finding_links"].collect()] == ["f2"]
    assert sliced["findings"].count() == 4  # filters do not flow from child to parent


def test_table_visuals_collapse_equal_rows_and_charts_group_by_name(state):
    assert reports.REPORTS["finding_severity_slicer"](state).count() == 4
    got = {r.column_name: r.total_column_storage_mb for r in reports.largest_columns(state).collect()}
    assert got == {"c": 1.5, "d": 0.0}
    shown = {r.column_name: r.total_column_storage_mb for r in reports.displayed(reports.largest_columns(state)).collect()}
    assert shown == {"c": "1.50", "d": "0.00"}
