"""Two scans of the same evidence: computed once, landed by both."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import rows_of
from conftest import SMALL
from modelsift.sources import testdata
from modelsift.sources.store import KINDS, LandingStore, land_scans
from modelsift.sources.testdata import SampleTables, holding_scan, prior_scan


@pytest.fixture
def fresh():
    """Scans without what other tests have written or pinned."""
    held = dict(testdata._SCANS)
    testdata.forget()
    yield
    testdata.forget()
    testdata._SCANS.update(held)


def rows(df):
    return rows_of(df.columns, df.collect())


def test_evidence_of_two_scans_is_computed_once(spark, fresh, monkeypatch):
    landed = []
    monkeypatch.setattr(LandingStore, "land", lambda self, kind, df, scan_id: landed.append((kind, scan_id, df)))
    monkeypatch.setattr(LandingStore, "land_outcomes", lambda *_: None)
    monkeypatch.setattr(LandingStore, "rows", lambda *_: None)
    entry._landed_scans(spark, SMALL)
    wanted = [k for k in KINDS if k not in ("stage_errors", "stage_outcomes")]
    assert sorted((k, s) for k, s, _ in landed) == sorted((k, s) for k in wanted for s in (testdata.SCAN_ID, testdata.PRIOR_SCAN_ID))
    for kind, _, df in landed:
        if kind in ("rule_violations", "refresh_history", "object_usage"):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "lineitem.parquet" not in plan, kind


def test_several_scans_land_apart(spark, tmp_path):
    store, tables = LandingStore(spark, str(tmp_path)), SampleTables(spark, SMALL)
    land_scans(store, {"a": tables, "b": prior_scan(spark, SMALL).landed.landed}, ["inventory", "capacity"])
    for scan_id in ("a", "b"):
        for kind in ("inventory", "capacity"):
            assert rows(store.landed(scan_id).__getattr__(kind)) == rows(getattr(tables, kind))
        assert store.landed(scan_id).item_access.count() == 0


def test_refreshes_from_written_lines(spark, tmp_path):
    """Orders that are repeated, without lines or without a customer; lines without an order or a date."""
    folder, whole = str(tmp_path), SampleTables(spark, SMALL)
    for name in ("customer", "orders", "lineitem"):
        df = whole.table(name)
        if name == "customer":
            df = df.filter("c_custkey % 7 <> 3")
        elif name == "orders":
            df = df.filter("o_orderkey % 11 <> 5").unionByName(df.filter("o_orderkey % 13 = 1"))
        else:
            df = df.filter("l_orderkey % 5 <> 2").withColumn("l_shipdate", F.expr("if(l_orderkey % 4 = 1, null, l_shipdate)"))
            df = df.unionByName(df.limit(20).withColumn("l_orderkey", F.lit(None).cast("bigint")))
        df.write.parquet(f"{folder}/{name}.parquet")
    expected = rows(SampleTables(spark, folder).refresh_history)
    held = SampleTables(spark, folder)
    held.hold_lines()
    assert "lineitem.parquet" not in held.refresh_history._jdf.queryExecution().executedPlan().toString()
    assert rows(held.refresh_history) == expected
    held.hold("refresh_history")
    assert rows(held.refresh_history) == expected


def test_holding_twice_writes_once(spark, fresh):
    first = holding_scan(spark, SMALL, "object_usage").landed.landed.object_usage
    assert holding_scan(spark, SMALL, "object_usage").landed.landed.object_usage is first
    assert prior_scan(spark, SMALL).landed.landed.object_usage is first
