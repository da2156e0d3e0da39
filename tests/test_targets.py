from datetime import datetime, timezone

import pytest

from modelsift.config import ScanConfig, parameter_guids, parameter_upns
from modelsift.operators import targets as T

W = [f"00000000-0000-4000-8000-{n:012d}" for n in range(4)]
M = [f"11111111-0000-4000-8000-{n:012d}" for n in range(9)]
ME = "00000000-0000-4000-8000-00000000aaaa"
NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
SPN = dict(auth_mode="spn_secret", scanner_object_id=ME)


def config(**changes):
    return ScanConfig(**{**dict(scan_id="s", started_at=NOW, completed_at=NOW, workspace_ids=W[:2]), **changes})


@pytest.fixture(scope="module")
def inventory(spark):
    rows = [
        (W[0].upper(), M[0].upper(), "Sales", False),
        (W[0], M[1], " modelBPA ", False),
        (W[0], M[2], "Default", True),
        (W[1], M[0], "Sales copy", False),
        (W[1], M[3], "Other", False),
        (W[2], M[4], "Outside", False),
    ]
    return spark.createDataFrame(rows, "workspace_id string, Id string, Name string, is_default_model boolean")


def resolve(spark, inventory, access=None, errors=None, workspaces=None, **changes):
    rows = T.resolve_targets(spark, config(**changes), inventory, access, workspaces, errors).collect()
    return {r.model_id: r for r in rows}


def test_scope_exclusions_defaults_and_first_workspace(spark, inventory):
    got = resolve(spark, inventory)
    assert set(got) == {M[0], M[3]}
    assert got[M[0]].workspace_id == W[0] and got[M[0]].scope_source == "WORKSPACE"
    assert got[M[3]].permission_precheck_status == "NOT_CHECKED_USER_MODE"
    assert got[M[3]].workspace_name == W[1]  # no name known
    # The scope order decides which workspace a model belongs to.
    assert resolve(spark, inventory, workspace_ids=[W[1], W[0]])[M[0]].workspace_id == W[1]
    assert M[2] in resolve(spark, inventory, include_default_models=True)


def test_requested_models(spark, inventory):
    got = resolve(spark, inventory, model_ids=f"{M[3].upper()}; {M[3]}")
    assert set(got) == {M[3]} and got[M[3]].scope_source == "MODEL"
    with pytest.raises(T.ScopeError, match=f"none of the workspaces.*{M[4]}, {M[8]}"):
        resolve(spark, inventory, model_ids=[M[4], M[8], M[3]])
    with pytest.raises(T.ScopeError, match=f"several workspaces.*{M[0]}"):
        resolve(spark, inventory, model_ids=[M[0]])
    with pytest.raises(T.ScopeError, match=f"exclusion list: {M[1]}"):
        resolve(spark, inventory, model_ids=[M[1]])


def test_safeguards(spark, inventory):
    with pytest.raises(T.ScopeError, match="may take 1"):
        resolve(spark, inventory, max_models_per_run=1)
    with pytest.raises(T.ScopeError, match="no model"):
        resolve(spark, inventory, workspace_ids=[W[3]])


def access(spark, rows):
    return spark.createDataFrame(
        rows,
        "workspace_id string, source_ordinal int, `Workspace Name` string, `User Type` string, `User Id` string, "
        "`User Details` string, Role string",
    )


def test_precheck_first_match_wins(spark, inventory):
    rows = [
        (W[0], 0, None, "User", ME, None, "Admin"),  # not a scanner principal type
        (W[0], 1, "First", "Service Principal", None, f'{{"id": "{ME.upper()}"}}', "Viewer"),
        (W[0], 2, "Second", "App", ME, None, "Admin"),
        (W[1], 0, None, "App", ME, None, " member "),
        (W[1], 1, "Too late", "App", None, None, None),
    ]
    got = resolve(spark, inventory, access(spark, rows), **SPN)
    assert got[M[0]].permission_precheck_status == "FAILED_INSUFFICIENT_ROLE"
    assert got[M[0]].permission_precheck_message == (
        "Scanner SPN role 'Viewer' is not in ['ADMIN', 'CONTRIBUTOR', 'MEMBER']."
    )
    assert got[M[0]].workspace_name == "First"
    # A default model that could not be opened stays, to be reported as skipped.
    assert M[2] in got
    assert got[M[3]].permission_precheck_status == "PASSED"
    assert got[M[3]].scanner_workspace_role == " member " and got[M[3]].workspace_name == W[1]


def test_precheck_other_outcomes(spark, inventory):
    rows = access(spark, [(W[0], 0, "Sales WS", "App", None, None, None)])
    errors = spark.createDataFrame([(W[1], "HttpError: 500")], "workspace_id string, message string")
    names = spark.createDataFrame([(W[1], "Listed")], "workspace_id string, workspace_name string")
    got = resolve(spark, inventory, rows, errors, names, **SPN)
    assert got[M[0]].permission_precheck_status == "FAILED_NOT_IN_WORKSPACE"
    assert got[M[3]].permission_precheck_status == "ERROR" and got[M[3]].workspace_name == "Listed"
    assert got[M[3]].permission_precheck_message == "Workspace access precheck failed: HttpError: 500"
    got = resolve(spark, inventory, rows, auth_mode="spn_keyvault")
    assert got[M[0]].permission_precheck_status == "FAILED_SCANNER_ID_REQUIRED"
    got = resolve(spark, inventory, rows, enforce_precheck=False, **SPN)
    assert got[M[0]].permission_precheck_status == "NOT_ENFORCED"


def test_parameters():
    assert parameter_guids(f"{M[1].upper()},{M[0]};\n{M[1]} ", "x") == (M[1], M[0])
    with pytest.raises(ValueError, match="is no GUID"):
        parameter_guids("nope", "x")
    with pytest.raises(ValueError, match="names no workspace"):
        parameter_guids(" ; ", "x", required=True)
    assert parameter_upns(" B@x; a@x,b@X ") == ("a@x", "b@x")


@pytest.mark.parametrize(
    "changes",
    [
        dict(required_roles=("Owner",)),
        dict(required_roles=()),
        dict(run_bpa=False, run_vpa=False),
        dict(access_sync_mode="other"),
        dict(auth_mode="none"),
        dict(scanner_object_id="x"),
    ],
)
def test_bad_configuration_is_refused(changes):
    with pytest.raises(ValueError):
        config(**changes)


def test_profiles():
    assert not config().enabled("usage")
    assert config(profile=" Deep ").enabled("usage")


def test_nameless_models_stay_and_a_gate_without_evidence_is_closed(spark):
    rows = [(W[0], M[0], None, False), (W[0], M[1], "b", False)]
    inventory = spark.createDataFrame(rows, "workspace_id string, Id string, Name string, is_default_model boolean")
    assert set(resolve(spark, inventory, workspace_ids=[W[0]])) == {M[0], M[1]}
    gated = config(workspace_ids=[W[0]], auth_mode="spn_secret", scanner_client_id=f"app {ME}")
    closed = T.workspace_precheck(T.scope_frame(spark, gated), None, gated).first()
    assert closed.permission_precheck_status == "ERROR"
