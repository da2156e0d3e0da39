"""Answers from the finding groups against the same answers from the findings."""

import pytest

import __spark_entry__ as entry
from compare import rows_of
from conftest import SMALL
from modelsift.plans import reports
from modelsift.plans.measures import ScanState, measures
from modelsift.sources.testdata import sample_scan

SLICERS = [
    {"findings": {"severity": ["WARNING"]}},
    {"findings": {"severity": ["ERROR", "INFO"], "rule_name": ["Rule 1", "Rule 2"]}, "overview": {"workspace_name": ["ASIA", "EUROPE"]}},
    {"overview": {"analysis_status": ["PARTIAL"]}, "column_storage": {"data_type": ["DateTime"]}},
    {"findings": {"affected_object_type": ["Column"]}},
    {"findings": {"severity": []}},
]


class FromFindings(ScanState):
    finding_groups = None
    finding_paths = None


@pytest.fixture(scope="module")
def scan(spark):
    return sample_scan(spark, SMALL).pin()


def rows(df):
    return rows_of(df.columns, df.collect())


@pytest.mark.parametrize("slicers", SLICERS)
def test_slicers_on_groups(scan, slicers):
    assert rows(measures(ScanState(scan), slicers)) == rows(measures(FromFindings(scan), slicers))
    for name in ("finding_severity_slicer", "findings_by_rule", "optimization_kpis"):
        report = reports.REPORTS[name]
        assert rows(report(ScanState(scan), slicers)) == rows(report(FromFindings(scan), slicers)), name


def test_navigation_without_links(scan):
    assert rows(reports.opportunity_navigation(ScanState(scan))) == rows(reports.opportunity_navigation(FromFindings(scan)))


def scans_of(df, table):
    return df._jdf.queryExecution().executedPlan().toString().count(f"{table}.parquet")


def test_few_scans(spark, scan):
    state = ScanState(scan)
    assert scans_of(measures(state, entry.SLICERS), "lineitem") == 0
    assert scans_of(reports.REPORTS["finding_severity_slicer"](state), "lineitem") == 0
    assert scans_of(reports.opportunity_navigation(state), "lineitem") == 0
    for name in ("key_uniqueness", "relationship_integrity"):
        assert scans_of(entry.library_queries()[name](spark, SMALL), "lineitem") == 0, name


def test_pinning_twice_writes_once(scan):
    before = scan.findings
    assert scan.pin().findings is before
