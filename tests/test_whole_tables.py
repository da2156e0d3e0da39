"""Columns that a table has beyond the declared ones."""

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from modelsift.sources.testdata import SAMPLE_SCHEMAS


def test_profile_and_rules_see_further_columns(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name in SAMPLE_SCHEMAS:
        path = f"{name}.parquet"
        if name != "nation":
            Path(folder, path).symlink_to(Path(SMALL, path))
    nation = spark.read.parquet(f"{SMALL}/nation.parquet").withColumn("n_extra", F.lit("same"))
    nation.write.parquet(f"{folder}/nation.parquet")
    queries = entry.library_queries()
    found = {(r.table_name, r.column_name): r for r in queries["column_profile"](spark, folder).collect()}
    extra = found["nation", "n_extra"]
    assert (extra.data_type, extra.row_count, extra.null_count, extra.cardinality) == ("string", nation.count(), 0, 1)
    assert len(found) == 1 + sum(len(ddl.split(", ")) for ddl in SAMPLE_SCHEMAS.values())
    broken = {(r["Object Name"], r["Rule Name"]) for r in queries["rule_evaluation"](spark, folder).collect()}
    assert ("n_extra", "Constant column") in broken
