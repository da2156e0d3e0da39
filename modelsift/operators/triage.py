"""Error-log triage."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsift.functions.messages import error_category, is_retryable


def classified_errors(log: DataFrame) -> DataFrame:
    message = F.col("message")
    return log.select("*", error_category(message).alias("error_category"), is_retryable(message).alias("is_retryable"))


def error_triage(log: DataFrame) -> DataFrame:
    """Counts per category and retryability."""
    return (
        classified_errors(log).groupBy("error_category", "is_retryable").agg(F.count(F.lit(1)).alias("error_count"))
    )
