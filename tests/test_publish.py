"""Whole runs on the small sample: history, current state, grants and run rows in tables."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from modelsift import schemas
from modelsift.operators import checks
from modelsift.operators.merge import viewer_requests
from modelsift.operators.targets import ScopeError
from modelsift.plans import publish
from modelsift.plans.measures import StoredState, measures
from modelsift.plans.reports import REPORTS
from modelsift.plans.scan import Scan
from modelsift.sinks.tables import Tables, history_name
from modelsift.sources.testdata import QuietTables, SampleTables, scan_config


EMPTIED = "NATION_15"


class MoreFailures(SampleTables):
    """The storage stage of one more model fails, so its storage slice becomes empty."""

    @property
    def stage_errors(self):
        model = self.inventory.filter(F.col("Dataset Name") == EMPTIED).select(F.col("Dataset Id").alias("model_id"))
        failing = model.select("model_id", F.lit("vpa").alias("stage"), F.lit("timed out").alias("message"))
        return SampleTables(self.spark, self.folder).stage_errors.unionByName(failing)


def scan(spark, landed=SampleTables, **changes):
    settings = {"fail_on_skipped_model": False, **changes}
    return Scan(spark, landed(spark, SMALL), scan_config(**settings))


def contents(tables):
    names = [*schemas.CURATED_TABLES, *(t for t in schemas.TECHNICAL_TABLES if t != "scan_run")]
    return {n: sorted(str(r) for r in publish.stored_table(tables, n).collect()) for n in names}


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark)


def test_runs_in_sequence(spark, tables):
    assert publish.run(tables, scan(spark), initialize_only=True) is None
    assert all(publish.stored_table(tables, n).isEmpty() for n in schemas.CURATED_TABLES)

    # A quiet run first, then the same scan id with failing and gated models.
    publish.run(tables, scan(spark, QuietTables, scan_id="run-1", auth_mode="user"))
    before = contents(tables)
    emptied = F.col("semantic_model_name") == EMPTIED
    assert publish.stored_table(tables, "column_storage").filter(emptied).count() > 0
    summary = json.loads(publish.run(tables, scan(spark, MoreFailures, scan_id="run-2")))
    after = contents(tables)
    assert summary["status"] == "PARTIAL" and summary["skipped_count"] > 0 and summary["failed_count"] > 0

    overview = {r.semantic_model_id: r for r in publish.stored_table(tables, "overview").collect()}
    models = {r.model_id: r for r in publish.stored_table(tables, "model_scan").filter("scan_id = 'run-2'").collect()}
    for model_id, row in models.items():
        usable = row.overall_status in ("SUCCEEDED", "PARTIAL")
        assert overview[model_id].analysis_id == ("run-2" if usable else "run-1")
    assert {r.overall_status for r in models.values()} == {"SUCCEEDED", "PARTIAL", "FAILED", "SKIPPED_PERMISSION"}
    # A processed model without rows is cleared.
    assert publish.stored_table(tables, "column_storage").filter(emptied).count() == 0
    # History keeps both scans; the latest state per model is that of the second.
    assert set(before["finding"]) < set(after["finding"])
    dims = publish.stored_table(tables, "dim_model").filter(F.col("model_id").isin(list(models))).collect()
    assert {r.latest_scan_id for r in dims} == {"run-2"}

    # Replaying a run changes nothing.
    publish.run(tables, scan(spark, MoreFailures, scan_id="run-2"))
    assert contents(tables) == after
    runs = {r.scan_id: r for r in publish.stored_table(tables, "scan_run").collect()}
    assert set(runs) == {"run-1", "run-2"} and runs["run-2"].status == "PARTIAL"
    assert runs["run-1"].status == "SUCCEEDED" and runs["run-1"].completed_at is not None


def test_stored_state_answers_reports_and_meets_its_contract(spark, tables):
    state = StoredState(spark)
    scanned = measures(state).first()
    assert scanned.models_scanned == state["overview"].count()
    assert scanned.total_findings == state["findings"].count()
    for name, report in REPORTS.items():
        assert report(state).columns, name
    for check in schemas.RELATIONSHIPS:
        assert checks.relationship_integrity(state, *check).first().orphan_rows == 0
    for name, keys in schemas.CURATED_KEYS.items():
        surplus = checks.key_uniqueness(name, state[name], keys).first().surplus_rows
        assert surplus == 0 or name == "findings"
    for name in schemas.CURATED_TABLES:
        rows = checks.schema_contract(name, state[name], schemas.curated_schema(name)).collect()
        assert {(r.status, r.null_rows) for r in rows} == {("OK", 0)}, name


def test_grants_are_synchronized(spark, tables):
    def sync(viewers):
        run = scan(spark, access_sync_mode="replace_scanner_managed", viewers=viewers)
        publish.sync_grants(tables, viewer_requests(run.targets, run.config), run.config)
        return run.targets.filter("permission_precheck_status = 'PASSED'").count()

    opened = sync("a@x; B@x")
    access = publish.stored_table(tables, "model_access")
    assert access.filter("is_active").count() == 2 * opened
    sync("b@x")
    access = publish.stored_table(tables, "model_access")
    assert {r.principal_upn for r in access.filter("is_active").collect()} == {"b@x"}
    assert access.filter("is_active").count() == opened
    assert access.filter("principal_upn = 'a@x' and not is_active and valid_to is not null").count() == opened


def test_failures_are_recorded_and_raised(spark, tables):
    few = dict(profile="standard", run_vpa=False, run_refresh=False, run_access_snapshot=False)
    with pytest.raises(publish.RunFailed, match="SKIPPED|skipped"):
        publish.run(tables, scan(spark, scan_id="run-7", fail_on_skipped_model=True, **few))
    with pytest.raises(ScopeError):
        publish.run(tables, scan(spark, scan_id="run-8", max_models_per_run=1))
    runs = {r.scan_id: r for r in spark.table(history_name("scan_run")).collect()}
    assert (runs["run-7"].status, runs["run-7"].error_category) == ("FAILED", "AUTHORIZATION")
    assert (runs["run-8"].status, runs["run-8"].target_count) == ("FAILED", 0)
    assert runs["run-8"].error_message.startswith("ScopeError: ")


def test_table_names():
    assert history_name("finding") == "model_history.history_finding"
    assert history_name("finding", "") == "history_finding"
