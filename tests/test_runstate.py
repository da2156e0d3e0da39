import json
from datetime import datetime, timedelta, timezone

import pytest

from modelsift.config import ScanConfig
from modelsift.operators import runstate as S

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
TARGET = (
    "workspace_id string, workspace_name string, model_id string, model_name string, scope_source string, "
    "permission_precheck_status string, scanner_workspace_role string, permission_precheck_message string"
)


def config(**changes):
    base = dict(scan_id="s", started_at=NOW, completed_at=NOW + timedelta(seconds=1.256), profile="deep")
    return ScanConfig(**{**base, "workspace_ids": ["00000000-0000-4000-8000-000000000001"], **changes})


def states(spark, errors, cfg, precheck="NOT_CHECKED_USER_MODE", modes=None, models=("a", "b")):
    targets = spark.createDataFrame(
        [("w", "W", m, m.upper(), "WORKSPACE", precheck, None, "why" if precheck == "ERROR" else None) for m in models],
        TARGET,
    )
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return S.model_states(
        targets,
        frame(errors, "model_id string, stage string, message string"),
        frame(modes or [("a", "DirectLake")], "model_id string, storage_mode string"),
        frame([("a", 10), ("b", 20)], "model_id string, model_size_bytes bigint"),
        frame([("w", "cap", "Capacity")], "workspace_id string, capacity_id string, capacity_name string"),
        cfg,
    )


def by_model(df):
    return {r.model_id: r for r in df.collect()}


def test_statuses_and_error_document(spark):
    errors = [("a", "refresh", "boom"), ("a", "capacity", "no"), ("b", "bpa", "x"), ("b", "vpa", "y"), ("b", "direct_lake", "z")]
    got = by_model(states(spark, errors, config()))
    a, b = got["a"], got["b"]
    assert (a.overall_status, a.refresh_status, a.direct_lake_status) == ("PARTIAL", "FAILED", "SUCCEEDED")
    assert (a.capacity_id, a.model_size_bytes, a.storage_mode) == (None, 10, "DirectLake")
    assert json.loads(a.error_json) == {"capacity": "no", "refresh": "boom"}
    # Storage was not read, so the mode is unknown and the fallback stage does not apply.
    assert (b.overall_status, b.storage_mode, b.direct_lake_status) == ("FAILED", "UNKNOWN", "NOT_APPLICABLE")
    assert b.error_json == '{"bpa":"x","vpa":"y"}'
    assert a.duration_seconds == 1.256


def test_disabled_stages(spark):
    got = by_model(states(spark, [("b", "bpa", "x")], config(profile="standard", run_vpa=False, run_refresh=False)))
    assert (got["a"].usage_status, got["a"].vpa_status, got["a"].refresh_status) == ("NOT_RUN",) * 3
    assert got["a"].overall_status == "SUCCEEDED" and got["a"].error_json is None
    # The only enabled core stage failed.
    assert got["b"].overall_status == "FAILED"


def test_gated_models(spark):
    cfg = config(auth_mode="spn_secret", run_refresh=False)
    got = by_model(states(spark, [("a", "bpa", "x")], cfg, precheck="ERROR"))["a"]
    assert (got.overall_status, got.bpa_status, got.refresh_status) == ("SKIPPED_PERMISSION",) * 2 + ("NOT_RUN",)
    assert got.access_snapshot_status == "NOT_RUN_PERMISSION_PRECHECK"
    assert (got.capacity_id, got.model_size_bytes, got.storage_mode) == (None, None, "UNKNOWN")
    assert got.error_json == '{"permission_precheck":"why"}'
    # Without enforcement the same models are scanned.
    open_ = by_model(states(spark, [], cfg.with_(enforce_precheck=False), precheck="NOT_ENFORCED"))
    assert open_["a"].overall_status == "SUCCEEDED"


@pytest.mark.parametrize(
    "statuses, flags, want",
    [
        (["SUCCEEDED"], {}, "SUCCEEDED"),
        (["SUCCEEDED", "PARTIAL"], {}, "PARTIAL"),
        (["SUCCEEDED", "FAILED"], {}, "PARTIAL"),
        (["SUCCEEDED", "FAILED"], dict(fail_on_failed_model=True), "FAILED"),
        (["SKIPPED_PERMISSION"], {}, "FAILED"),
        (["SKIPPED_PERMISSION"], dict(fail_on_skipped_model=False), "SKIPPED_PERMISSION"),
        (["SKIPPED_PERMISSION", "SUCCEEDED"], dict(fail_on_skipped_model=False), "PARTIAL"),
        ([], {}, "SUCCEEDED"),
    ],
)
def test_run_status(spark, statuses, flags, want):
    rows = [(f"m{i}", "w", s) for i, s in enumerate(statuses)]
    df = spark.createDataFrame(rows, "model_id string, workspace_id string, overall_status string")
    run = S.run_row(df, config(**flags)).first()
    assert run.status == want and run.target_count == len(statuses)
    skipped = statuses.count("SKIPPED_PERMISSION")
    if skipped and flags.get("fail_on_skipped_model", True):
        assert run.error_category == "AUTHORIZATION" and run.error_message.startswith(f"{skipped} model(s)")
    else:
        assert run.error_category is None and run.error_message is None


def test_failed_and_initialized_runs(spark):
    df = spark.createDataFrame([], "model_id string, workspace_id string, overall_status string")
    failed = S.run_row(df, config(), error=("TimeoutError", "operation timed out")).first()
    assert (failed.status, failed.error_category, failed.error_message) == (
        "FAILED",
        "TIMEOUT",
        "TimeoutError: operation timed out",
    )
    assert S.run_row(df, config(), initialize_only=True).first().status == "INITIALIZED"
    running = S.running_row(df, config(requested_by=" A@X ")).first()
    assert (running.status, running.completed_at, running.requested_by_upn) == ("RUNNING", None, "a@x")


def test_parameters_hash_changes_with_settings(spark):
    df = spark.createDataFrame([], "model_id string, workspace_id string, overall_status string")
    hashes = {S.run_row(df, c).first().parameters_hash for c in (config(), config(), config(min_column_size_mb=1.0))}
    assert len(hashes) == 2


def test_summary(spark):
    df = states(spark, [("b", "bpa", "x"), ("b", "vpa", "y")], config()).drop("finding_count")
    counts = spark.createDataFrame([("a", 3)], "model_id string, finding_count bigint")
    rows = S.model_rows(df, counts)
    summary = json.loads(S.run_summary(rows, config()).first().summary_json)
    assert summary["duration_seconds"] == 1.26 and summary["status"] == "PARTIAL" and summary["error"] is None
    assert [(m["model_id"], m["status"], m["finding_count"]) for m in summary["model_results"]] == [
        ("a", "SUCCEEDED", 3),
        ("b", "FAILED", 0),
    ]
