"""Typed evidence rows: storage, usage, refresh, fallback checks and access.

Every input has been projected by sources.landing.evidence and joined to its target model.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsift.config import USAGE_METHOD_MONITORING, ScanConfig
from modelsift.functions.messages import is_fallback
from modelsift.functions.text import blank_to_null, json_text, stable_id, strip
from modelsift.functions.values import duration_seconds
from modelsift.operators.ranking import position_in_group, top_per_group
from modelsift.sources.landing import RAW

HOUR = 3600
NO_START = 1 << 52  # refreshes without a start come last


def _seen(df: DataFrame, config: ScanConfig) -> Column:
    clock = F.lit(config.completed_at)
    return (F.coalesce("detected_at", clock) if "detected_at" in df.columns else clock).cast("timestamp")


def _ordinal(df: DataFrame) -> Column:
    return (F.col("source_ordinal") if "source_ordinal" in df.columns else F.lit(0)).cast("bigint")


def _unique_ordinal(df: DataFrame, kind: str) -> Column:
    if "source_ordinal" not in df.columns:
        raise ValueError(f"{kind} evidence needs source_ordinal, its position in the collector's answer.")
    return _ordinal(df)


def with_raw_json(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw_json", json_text(rows, RAW)).drop(RAW)


def _share(config: ScanConfig) -> Column:
    size, model = F.col("total_size_bytes"), F.col("model_size_bytes")
    return F.when(model > 0, F.lit(100.0) * size / model)


def column_rows(columns: DataFrame, config: ScanConfig) -> DataFrame:
    """The landed row stays a struct: most uses of these rows never show it."""
    return columns.select(
        stable_id(config.scan_id, F.col("model_id"), "VPA_COLUMN", F.col("table_name"), F.col("column_name")).alias(
            "evidence_id"
        ),
        F.lit(config.scan_id).alias("scan_id"),
        "workspace_id",
        "model_id",
        "table_name",
        "column_name",
        "data_type",
        "encoding",
        "cardinality",
        "data_size_bytes",
        "dictionary_size_bytes",
        "hierarchy_size_bytes",
        "total_size_bytes",
        _share(config).alias("model_size_pct"),
        RAW,
        _seen(columns, config).alias("detected_at"),
        "workspace_name",
        "model_name",
        _ordinal(columns).alias("evidence_ordinal"),
    )


def table_rows(tables: DataFrame, config: ScanConfig) -> DataFrame:
    return tables.select(
        stable_id(config.scan_id, F.col("model_id"), "VPA_TABLE", F.col("table_name")).alias("evidence_id"),
        F.lit(config.scan_id).alias("scan_id"),
        "workspace_id",
        "model_id",
        "table_name",
        "row_count",
        "data_size_bytes",
        "dictionary_size_bytes",
        "hierarchy_size_bytes",
        "total_size_bytes",
        _share(config).alias("model_size_pct"),
        json_text(tables, RAW).alias("raw_json"),
        _seen(tables, config).alias("detected_at"),
    )


def storage_modes(partitions: DataFrame) -> DataFrame:
    """Distinct partition modes of each model, sorted and joined. Models without any are absent."""
    modes = partitions.filter(F.col("mode").isNotNull()).select("model_id", strip("mode").alias("mode")).distinct()
    return modes.groupBy("model_id").agg(
        F.array_join(F.array_sort(F.collect_list("mode")), ", ").alias("storage_mode")
    )


def usage_rows(usage: DataFrame, config: ScanConfig) -> DataFrame:
    monitored = config.usage_method == USAGE_METHOD_MONITORING
    return usage.select(
        stable_id(
            config.scan_id, F.col("model_id"), "USAGE", F.col("table_name"), F.col("object_type"), F.col("object_name")
        ).alias("usage_id"),
        F.lit(config.scan_id).alias("scan_id"),
        "workspace_id",
        "model_id",
        "table_name",
        "object_type",
        "object_name",
        "is_used",
        F.coalesce("usage_count", F.lit(0)).alias("usage_count"),
        F.lit(config.usage_method).alias("usage_method"),
        F.lit(config.usage_window_days if monitored else None).cast("int").alias("usage_window_days"),
        json_text(usage, RAW).alias("raw_json"),
        _seen(usage, config).alias("detected_at"),
        "workspace_name",
        "model_name",
        _ordinal(usage).alias("evidence_ordinal"),
    )


def refresh_rows(history: DataFrame, config: ScanConfig, k: int | None = None) -> DataFrame:
    """The refreshes of each model, or its k latest. The position, latest first, stands in for a missing request id."""
    order = [F.col("start_time").desc_nulls_last(), _ordinal(history), F.col(RAW)]
    if k is None:
        age = F.coalesce(-F.unix_seconds("start_time"), F.lit(NO_START))
        refreshes = position_in_group(history.withColumn("_age", age), "model_id", "_age", order, span=HOUR)
    else:
        refreshes = top_per_group(history, ["model_id"], order, k).withColumn("position", F.col("rank") - 1)
    request = F.coalesce(blank_to_null(F.col("request_id")), F.col("position").cast("string"))
    return refreshes.select(
        stable_id(config.scan_id, F.col("model_id"), "REFRESH", request).alias("refresh_id"),
        F.lit(config.scan_id).alias("scan_id"),
        "workspace_id",
        "model_id",
        "request_id",
        "refresh_type",
        "status",
        "start_time",
        "end_time",
        duration_seconds(F.col("start_time"), F.col("end_time")).alias("duration_seconds"),
        json_text(refreshes, RAW).alias("raw_json"),
        F.lit(config.completed_at).cast("timestamp").alias("captured_at"),
    )


def fallback_checks(reasons: DataFrame, config: ScanConfig) -> DataFrame:
    ordered = reasons.withColumn("evidence_ordinal", _unique_ordinal(reasons, "Fallback"))
    placed = position_in_group(ordered, "model_id", "evidence_ordinal", [F.col(RAW)])
    return placed.select(
        stable_id(
            config.scan_id, F.col("model_id"), "DIRECT_LAKE_FALLBACK", F.col("table_name"), F.col("position")
        ).alias("check_id"),
        F.lit(config.scan_id).alias("scan_id"),
        "workspace_id",
        "model_id",
        F.lit("FALLBACK_REASON").alias("check_type"),
        "table_name",
        F.when(is_fallback(F.col("reason")), "ISSUE").otherwise("OK").alias("status"),
        "reason",
        json_text(placed, RAW).alias("raw_json"),
        _seen(reasons, config).alias("detected_at"),
        "workspace_name",
        "model_name",
        "evidence_ordinal",
    )


def access_rows(access: DataFrame, config: ScanConfig) -> DataFrame:
    ordered = access.withColumn("evidence_ordinal", _unique_ordinal(access, "Access"))
    placed = position_in_group(ordered, "model_id", "evidence_ordinal", [F.col(RAW)])
    return placed.select(
        stable_id(
            config.scan_id, F.col("model_id"), F.col("principal_id"), F.col("principal_upn"), F.col("position")
        ).alias("access_id"),
        F.lit(config.scan_id).alias("scan_id"),
        "workspace_id",
        "model_id",
        "principal_id",
        "principal_name",
        "principal_type",
        blank_to_null(F.lower("principal_upn")).alias("principal_upn"),
        "permissions",
        "additional_permissions",
        json_text(placed, RAW).alias("raw_json"),
        F.lit(config.completed_at).cast("timestamp").alias("captured_at"),
    )
