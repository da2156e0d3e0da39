"""Landed outcomes and evidence by scan."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from modelsift.plans.scan import Scan
from modelsift.sources.store import LandingStore, land_all
from modelsift.sources.testdata import SampleTables, outcomes_of, scan_config

STAGES = ["bpa", "vpa", "refresh", "usage", "direct_lake", "access_snapshot"]


@pytest.fixture(scope="module")
def sample(spark):
    return SampleTables(spark, SMALL)


def test_a_stage_without_an_outcome_is_not_run(spark, sample, tmp_path):
    store = LandingStore(spark, str(tmp_path))
    config = scan_config(scan_id="2024/a b", auth_mode="user")
    land_all(store, sample, config.scan_id)
    models = [r[0] for r in sample.inventory.select("Dataset Id").orderBy("Dataset Id").collect()]
    rows = [(m, s, "SUCCEEDED", None) for m in models for s in STAGES]
    rows.remove((models[1], "vpa", "SUCCEEDED", None))
    rows.remove((models[2], "access_snapshot", "SUCCEEDED", None))
    rows += [(models[3].upper(), "usage", "FAILED", None), (models[4], "refresh", "FAILED", "timed out")]
    store.land_outcomes(spark.createDataFrame(rows, "model_id string, stage string, status string, message string"), config.scan_id)
    scan = Scan(spark, store.landed(config.scan_id), config)
    states = {r.model_id: r for r in scan.states.collect()}
    get = lambda i: states[models[i]]
    assert get(0).overall_status == "SUCCEEDED" and get(0).error_json is None
    assert (get(1).overall_status, get(1).vpa_status, get(1).bpa_status) == ("NOT_RUN", "NOT_RUN", "SUCCEEDED")
    assert get(1).storage_mode == "UNKNOWN" and '"vpa":"The stage has no landed outcome."' in get(1).error_json
    assert (get(2).overall_status, get(2).access_snapshot_status) == ("NOT_RUN", "NOT_RUN")
    assert (get(3).overall_status, get(3).usage_status) == ("PARTIAL", "FAILED")
    assert '"usage":"No message."' in get(3).error_json and '"refresh":"timed out"' in get(4).error_json
    published = {r.model_id for r in scan.curated_models.select("model_id").collect()}
    assert models[1] not in published and models[2] not in published and models[3] in published
    run = scan.run_row.first()
    assert run.failed_count == 2 and run.status == "PARTIAL"
    # Evidence of the stage that has no outcome is not read either.
    assert scan.column_rows.filter(F.col("model_id") == models[1]).isEmpty()


def test_only_the_own_scan_is_read(spark, sample, tmp_path):
    store = LandingStore(spark, str(tmp_path))
    land_all(store, sample, "old", ["storage_columns", "inventory"])
    land_all(store, sample, "new", ["inventory"])
    assert store.landed("old").storage_columns.count() > 0
    assert store.landed("new").storage_columns.isEmpty() and store.landed("new").stage_outcomes.isEmpty()
    assert all("/scan-" in f and store.folder("inventory", "old") not in f for f in store.landed("new").inventory.inputFiles())
    # Frames that hold several scans in one table are narrowed by their scan_id.
    both = sample.storage_columns.withColumn("scan_id", F.lit("a")).unionByName(sample.storage_columns.withColumn("scan_id", F.lit("b")))
    scan = Scan(spark, type("L", (), {"storage_columns": both, "inventory": sample.inventory})(), scan_config(scan_id="b"))
    assert scan.landed.storage_columns.count() == sample.storage_columns.count()
    assert scan.landed.storage_columns.columns == sample.storage_columns.columns


def test_an_outcome_follows_its_evidence(spark, sample, tmp_path):
    store = LandingStore(spark, str(tmp_path))
    models = sample.inventory.select(F.col("Dataset Id").alias("model_id"))

    def broken():
        raise TimeoutError("timed out")

    assert store.collect("vpa", models, {"storage_columns": lambda: sample.storage_columns, "storage_tables": broken}, "s") == "FAILED"
    assert store.collect("bpa", models, {"rule_violations": lambda: sample.rule_violations}, "s") == "SUCCEEDED"
    outcomes = store.landed("s").stage_outcomes.groupBy("stage", "status", "message").count().collect()
    n = models.count()
    assert {tuple(r) for r in outcomes} == {("vpa", "FAILED", "TimeoutError: timed out", n), ("bpa", "SUCCEEDED", None, n)}
    # Landing a kind again replaces it.
    store.collect("bpa", models, {"rule_violations": lambda: sample.rule_violations.limit(1)}, "s")
    assert store.landed("s").rule_violations.count() == 1


def test_outcomes_of_errors(sample):
    rows = outcomes_of(sample.inventory, sample.stage_errors).collect()
    assert len(rows) == sample.inventory.count() * len(STAGES)
    assert {(r.stage, r.message) for r in rows if r.status == "FAILED"} == {
        (r.stage, r.message) for r in sample.stage_errors.collect()
    }
