from datetime import datetime

import pytest
from pyspark.sql import functions as F

from modelsift.sources import landing


def test_first_heading_with_a_value_wins(spark):
    df = spark.createDataFrame(
        [("m", None, "T2", "9 kb", float("nan"), 3), ("m", "T1", "T2", "x", 2.9, None)],
        "model_id string, `Table` string, `TABLE-name` string, `Total Size` string, `Cardinality` double, "
        "`Column Cardinality` int",
    )
    got = landing.evidence(df, "storage_columns", raw=False).collect()
    # "Table Name" is tried before "Table".
    assert [r.table_name for r in got] == ["T2", "T2"]
    assert [r.total_size_bytes for r in got] == [9 * 1024, None]
    assert [r.cardinality for r in got] == [3, 2]
    assert got[0].encoding is None and got[0].hierarchy_size_bytes is None


def test_a_present_value_is_not_replaced_because_it_cannot_be_parsed(spark):
    df = spark.createDataFrame([("m", "junk", "7")], "model_id string, `Total Size` string, `Total Size Bytes` string")
    assert landing.evidence(df, "storage_columns", raw=False).first().total_size_bytes is None


def test_equal_headings_the_last_wins(spark):
    df = spark.createDataFrame([("m", "first", "last")], "model_id string, `Rule Name` string, `rule_name` string")
    assert landing.evidence(df, "rule_violations").first().rule_name == "last"
    assert landing.with_canonical_names(df).columns == ["model_id", "rule_name"]


def test_texts_are_kept_whole(spark):
    df = spark.createDataFrame([("m", "x" * 9000, "y" * 9000)], "model_id string, `Rule` string, `Description` string")
    got = landing.evidence(df, "rule_violations").first()
    assert (len(got.rule_name), len(got.description)) == (9000, 9000)


def test_ids_are_compared_in_lower_case(spark):
    df = spark.createDataFrame([("ABC", "r")], "model_id string, `Rule` string")
    assert landing.evidence(df, "rule_violations").first().model_id == "abc"


def test_missing_usage_flag_means_used(spark):
    df = spark.createDataFrame([("m", None), ("m", "No"), ("m", "Y")], "model_id string, `Is Used` string")
    assert [r.is_used for r in landing.evidence(df, "object_usage").collect()] == [True, False, True]


def test_refresh_times(spark):
    df = spark.createDataFrame([("m", "2024-01-01T00:00:00Z", "bad")], "model_id string, StartTime string, `End Time` string")
    got = landing.evidence(df, "refresh_history").select(F.col("start_time").cast("string"), "end_time").first()
    assert (got[0], got[1]) == (str(datetime(2024, 1, 1)), None)


def test_inventory_needs_id_and_name(spark):
    df = spark.createDataFrame([("W", "X", "n")], "workspace_id string, `Item Id` string, `Display Name` string")
    got = landing.inventory(df).first()
    assert (got.workspace_id, got.model_id, got.model_name, got.is_default_model) == ("w", "x", "n", False)
    with pytest.raises(ValueError, match="ID/name"):
        landing.inventory(df.drop("Display Name"))


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([("m", "Rule 1"), ("m", None)], "model_id string, `Rule` string")
    path = str(tmp_path / fmt)
    writer = df.write.format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)
    back = landing.read_landing(spark, path, fmt, df.schema)
    assert sorted(str(r[1]) for r in back.collect()) == ["None", "Rule 1"]


def test_text_formats_need_a_schema(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        landing.read_landing(spark, str(tmp_path), "json")


def test_workspace_names_by_heading(spark):
    first = spark.createDataFrame([("A1", " North "), ("b2", "")], "ID string, `Workspace Name` string")
    assert [tuple(r) for r in landing.workspaces(first).collect()] == [("a1", "North"), ("b2", None)]
    second = spark.createDataFrame([("A1", None, "South")], "workspace_id string, name string, workspace_name string")
    assert [tuple(r) for r in landing.workspaces(second).collect()] == [("a1", "South")]
    nameless = spark.createDataFrame([("A1",)], "workspace_id string")
    assert [tuple(r) for r in landing.workspaces(nameless).collect()] == [("a1", None)]
