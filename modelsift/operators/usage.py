"""Unused-object analysis over a query log."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OBJECT_KEY = ["model_id", "table_name", "object_name"]


def unused_objects(objects: DataFrame, usage_log: DataFrame, now: datetime, days: int) -> DataFrame:
    """Every object with its number of references in the last days; none means unused.

    The log is counted per object before the join, so a hot object costs one row per task.
    """
    # Bounds of the column's own type, so that the filter reaches the scan.
    first, last = (F.lit(t).cast(usage_log.schema["ts"].dataType) for t in (now - timedelta(days=days), now))
    uses = (
        usage_log.filter((F.col("ts") >= first) & (F.col("ts") < last))
        .groupBy(*OBJECT_KEY)
        .agg(F.count(F.lit(1)).alias("usage_count"))
    )
    return objects.join(uses, OBJECT_KEY, "left").select(
        "model_id",
        "table_name",
        "object_type",
        "object_name",
        F.col("usage_count").isNotNull().alias("is_used"),
        F.coalesce("usage_count", F.lit(0)).alias("usage_count"),
    )
