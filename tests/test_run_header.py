import json

from conftest import SMALL
from modelsift.operators import runstate as S
from modelsift.plans import publish
from modelsift.sinks.tables import Tables
from modelsift.sources.testdata import SampleTables, scan_config
from modelsift.plans.scan import Scan


def test_run_returns_counts_and_stores_every_model(spark):
    config = scan_config(
        scan_id="run-header", fail_on_skipped_model=False, profile="standard", run_vpa=False, run_refresh=False,
        run_access_snapshot=False,
    )
    scan = Scan(spark, SampleTables(spark, SMALL), config)
    tables = Tables(spark)
    header = json.loads(publish.run(tables, scan))
    summary = json.loads(scan.summary.first().summary_json)
    entries = summary.pop("model_results")
    assert header == summary and "model_results" not in header and header["target_count"] == len(entries) > 0
    stored = publish.stored_table(tables, "model_scan").filter("scan_id = 'run-header'").collect()
    want = {m["model_id"]: m for m in entries}
    assert {r.model_id for r in stored} == set(want)
    for r in stored:
        m = want[r.model_id]
        assert (r.workspace_id, r.model_name, r.overall_status, r.permission_precheck_status) == (
            m["workspace_id"], m["model_name"], m["status"], m["permission_precheck_status"],
        )
        assert (r.scanner_workspace_role, r.finding_count or 0) == (m["scanner_workspace_role"], m["finding_count"])
    plan = S.run_header(scan.states, config)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
