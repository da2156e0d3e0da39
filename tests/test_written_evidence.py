"""Evidence that many tables are made of is shuffled once; upserts into history leave other scans alone."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from modelsift.operators.merge import upserted, upserted_in_scan
from modelsift.sources import testdata
from modelsift.sources.testdata import SampleTables, prior_scan, sample_scan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_read_once_for_all_evidence(spark):
    tables = SampleTables(spark, SMALL)
    assert plan_of(tables.rule_violations).count("lineitem.parquet") == 1
    tables.hold_lines()
    for name in ("rule_violations", "storage_columns", "storage_tables", "model_size", "object_usage"):
        assert "lineitem.parquet" not in plan_of(getattr(tables, name)), name
    prior = prior_scan(spark, SMALL).landed.landed
    assert prior.column_groups is sample_scan(spark, SMALL).landed.landed.column_groups


def test_tasks_do_not_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(testdata, "LINES_PER_TASK", 100)
    parts = []
    monkeypatch.setattr(testdata, "written", lambda df, name: parts.append(plan_of(df)) or df)
    tables = SampleTables(spark, SMALL)
    tables.column_groups.count()
    wanted = -(-tables.table("lineitem").count() // 100)
    assert f", {wanted}), REPARTITION_BY_NUM" in parts[0]


def test_large_tables_are_not_cut_into_as_many_parts_as_cores(spark):
    """A number of parts fixed by the cores lets a task's share grow with the table."""
    plan = plan_of(SampleTables(spark, SMALL).spread("lineitem", "l_orderkey"))
    assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan


def test_columns_of_repeated_and_missing_suppliers(spark, tmp_path):
    """Counted as the join of lines and suppliers has them: as often as a supplier is listed, not at all when it is not."""
    folder = str(tmp_path)
    tables = SampleTables(spark, SMALL)
    for name in ("lineitem", "supplier"):
        df = tables.table(name)
        if name == "supplier":
            again, moved = df.filter("s_suppkey % 3 = 0"), df.filter("s_suppkey % 4 = 0")
            df = df.filter("s_suppkey % 5 <> 1").unionByName(again).unionByName(moved.withColumn("s_nationkey", F.col("s_nationkey") + 1))
        else:
            odd = df.limit(20).withColumn("l_suppkey", F.lit(None).cast("bigint"))
            df = df.unionByName(odd).unionByName(df.limit(30).withColumn("l_partkey", F.lit(None).cast("bigint")))
        df.write.parquet(f"{folder}/{name}.parquet")
    odd = SampleTables(spark, folder)
    slot = (F.col("l_partkey") % 50).alias("slot")
    joined = odd.table("lineitem").join(odd.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    expected = joined.groupBy(
        F.concat(F.lit("table_"), F.col("l_suppkey").cast("string")).alias("Table Name"), "s_nationkey", slot
    ).agg(
        F.count_distinct("l_orderkey").alias("orders"),
        F.sum("l_quantity").cast("bigint").alias("quantity"),
        F.sum("l_linenumber").alias("lines"),
        F.count(F.lit(1)).alias("n"),
    )
    columns = ["Table Name", "slot", "orders", "quantity", "lines", "n"]
    got, want = odd.column_groups.select(columns), expected.select(columns)
    assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_other_scans_are_not_joined(spark):
    held = spark.createDataFrame([("a", "s0", 1), ("b", "s1", 1), ("c", "s1", 1), ("d", None, 1)], "k string, scan_id string, v int")
    new = spark.createDataFrame([("b", "s1", 2), ("e", "s1", 2), ("e", "s1", 3)], "k string, scan_id string, v int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(upserted_in_scan(held, new, ["k"], "s1")) == rows(upserted(held, new, ["k"]))


def test_upsert_does_not_shuffle_earlier_history(spark):
    plan = entry.library_queries()["upsert_finding_history"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("LeftAnti") :]
    assert "rule-lines" not in joined and "lineitem" not in plan
    assert "evidence_json" not in plan
