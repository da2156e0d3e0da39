"""Repeated keys are found by their hashes: only rows of repeated hashes are brought together by key."""

import pytest
from pyspark.sql import functions as F

from compare import rows_of
from conftest import SMALL
from modelsift.operators import checks, ranking, rollup
from modelsift.sources.testdata import sample_scan

# Two columns hash alike when the same value stands in either and the other is null.
KEYS = [(None, "x"), ("x", None), ("y", "y"), ("y", "y"), ("z", "z"), (None, None), (None, None), (None, "w"), ("u", "v")]


def rows(df):
    return rows_of(df.columns, df.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def keyed(spark):
    return spark.createDataFrame(KEYS, "a string, b string")


@pytest.mark.parametrize("most", [ranking.BROADCAST_HASHES, 1])
def test_wide_keys_are_counted_exactly(keyed, monkeypatch, most):
    """Equal hashes of different keys, null keys, and more repeated hashes than may be broadcast."""
    monkeypatch.setattr(ranking, "BROADCAST_HASHES", most)
    got = checks.key_uniqueness("t", keyed, ["a", "b"], wide=True).first()
    assert (got.row_count, got.distinct_keys, got.duplicate_keys, got.surplus_rows) == (9, 7, 2, 2)
    for part in (keyed, keyed.distinct(), keyed.filter(F.lit(False))):
        assert rows(checks.key_uniqueness("t", part, ["a", "b"], wide=True)) == rows(checks.key_uniqueness("t", part, ["a", "b"]))


def test_rows_are_parted_by_the_hash_of_their_key(keyed):
    alone, others, n = ranking.by_key_hash(keyed, ["a", "b"])
    assert n == alone.count() == 3 and alone.columns == others.columns == ["a", "b"]
    assert rows(alone.unionByName(others)) == rows(keyed)


def test_lone_findings_are_not_shuffled(spark, monkeypatch):
    findings = sample_scan(spark, SMALL).usable_findings
    columns = ["model_id", "source", "category", "impact_area", "finding_id", "rule_name"]
    once = findings.select(columns).dropDuplicates(["finding_id"]).localCheckpoint()
    assert "Exchange" not in plan_of(rollup.linked_findings(once))
    first = once.limit(3)
    other = first.limit(1).withColumn("category", F.lit("another domain"))
    repeated = once.unionByName(first).unionByName(first).unionByName(other)
    with_ids = rollup.keyed(repeated).withColumn("opportunity_id", rollup._opportunity_id())
    expected = with_ids.groupBy("opportunity_id", "finding_id", "rule_name").agg(F.count(F.lit(1)).alias("link_count"))
    assert rows(rollup.linked_findings(repeated)) == rows(expected)
    monkeypatch.setattr(ranking, "BROADCAST_HASHES", 1)
    assert rows(rollup.linked_findings(repeated)) == rows(expected)


def test_ids_of_findings_and_columns_are_shuffled_as_hashes(spark):
    scan = sample_scan(spark, SMALL)
    for name, key in (("curated_findings", "finding_id"), ("column_storage", "column_storage_record_id")):
        df = getattr(scan, name).dropDuplicates([key]).localCheckpoint()
        assert "hashpartitioning" not in plan_of(checks.key_uniqueness(name, df, [key], wide=True)), name
