"""Normalized findings of the four evidence sources."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsift.config import STAGE_LABEL, USAGE_METHOD_MONITORING, VERSION, ScanConfig
from modelsift.functions import messages as M
from modelsift.functions.text import blank_to_null, json_text, stable_id, strip
from modelsift.operators.ranking import top_per_group
from modelsift.sources.landing import RAW

# Sources in the order their findings are seen.
SOURCES = ("BPA", "VPA_HEURISTIC", "UNUSED_OBJECT_ANALYSIS", "DIRECT_LAKE")
RULE_SEVERITIES = ["INFO", "WARNING", "ERROR"]

# Columns that fix "first seen" among findings; not part of the stored table.
ORDER_COLUMNS = ["source_rank", "evidence_ordinal"]


def finding_rows(
    df: DataFrame,
    config: ScanConfig,
    source: str,
    rule_name: Column,
    object_type: Column,
    table_name: Column,
    object_name: Column,
    ordinal: Column,
    **values: Column,
) -> DataFrame:
    """Finding columns with their defaults; values given by the source replace the defaults."""
    text = lambda v: F.lit(v).cast("string")
    seen = F.col("detected_at") if "detected_at" in df.columns else F.lit(None)
    columns = {
        "finding_id": stable_id(F.lit(config.scan_id), F.col("model_id"), source, rule_name, table_name, object_name),
        "scan_id": F.lit(config.scan_id),
        "scanner_version": F.lit(VERSION),
        "solution_stage": F.lit(STAGE_LABEL),
        "workspace_id": F.col("workspace_id"),
        "workspace_name": F.col("workspace_name"),
        "model_id": F.col("model_id"),
        "model_name": F.col("model_name"),
        "source": F.lit(source),
        "category": text(None),
        "rule_id": stable_id(source, rule_name),
        "rule_name": rule_name,
        "severity": text("INFO"),
        "confidence": text("MEDIUM"),
        "impact_area": text("MODEL_QUALITY"),
        "object_type": object_type,
        "table_name": table_name,
        "object_name": object_name,
        "finding_text": text(None),
        "recommended_action": text(None),
        "technical_evidence": text(None),
        "evidence_json": text(None),
        "estimated_saving_bytes_low": F.lit(None).cast("bigint"),
        "estimated_saving_bytes_high": F.lit(None).cast("bigint"),
        "reclaimable_upper_bound_bytes": F.lit(None).cast("bigint"),
        "cu_saving_status": text("NOT_ESTIMATED_STAGE_2_REQUIRED"),
        "benefit_validation_status": text("NOT_STARTED"),
        "change_risk": text("MEDIUM"),
        "validation_required": F.lit(True),
        "documentation_url": text(None),
        "detected_at": F.coalesce(seen, F.lit(config.completed_at)).cast("timestamp"),
        "source_rank": F.lit(SOURCES.index(source)),
        "evidence_ordinal": ordinal.cast("bigint"),
    }
    columns.update(values)
    return df.select(*[c.alias(name) for name, c in columns.items()])


def _ordinal(df: DataFrame) -> Column:
    return F.col("source_ordinal") if "source_ordinal" in df.columns else F.lit(0)


def rule_findings(violations: DataFrame, config: ScanConfig) -> DataFrame:
    """One finding per rule violation."""
    rule = F.coalesce("rule_name", F.lit("BPA rule"))
    severity = F.upper(strip(F.coalesce("severity", F.lit("Warning"))))
    described = F.coalesce(blank_to_null(F.col("description")), rule)
    return finding_rows(
        violations,
        config,
        "BPA",
        rule,
        F.col("object_type"),
        F.col("table_name"),
        F.col("object_name"),
        _ordinal(violations),
        category=F.col("category"),
        severity=F.when(severity.isin(RULE_SEVERITIES), severity).otherwise("WARNING"),
        confidence=F.lit("HIGH"),
        impact_area=F.when(F.lower("category") == "performance", "PERFORMANCE").otherwise("MODEL_QUALITY"),
        finding_text=described,
        recommended_action=F.col("description"),
        technical_evidence=F.concat(F.lit("Deterministic BPA rule violation: "), rule),
        evidence_json=json_text(violations, RAW),
        documentation_url=F.col("documentation_url"),
    )


def storage_candidates(columns: DataFrame, config: ScanConfig) -> DataFrame:
    """Columns that are large and either a big share of the model or of high cardinality."""
    share = F.coalesce("model_size_pct", F.lit(0.0)) >= config.min_column_model_pct
    distinct = F.coalesce("cardinality", F.lit(0)) >= config.high_cardinality
    large = F.coalesce("total_size_bytes", F.lit(0)) >= config.min_column_bytes
    return columns.filter(large & (share | distinct))


def storage_findings(columns: DataFrame, config: ScanConfig, k: int | None = None) -> DataFrame:
    """A finding for every candidate; k keeps the k largest of each model. The largest are seen first."""
    ranked = storage_candidates(columns, config)
    if k is not None:
        order = [F.col(c).asc_nulls_first() for c in ("evidence_ordinal", "table_name", "column_name", RAW)]
        ranked = top_per_group(ranked, ["model_id"], [F.desc("total_size_bytes"), *order], k)
    share = F.coalesce("model_size_pct", F.lit(0.0))
    return finding_rows(
        ranked,
        config,
        "VPA_HEURISTIC",
        F.when(
            F.coalesce("cardinality", F.lit(0)) >= config.high_cardinality, "Large high-cardinality column"
        ).otherwise("Large storage contributor"),
        F.lit("Column"),
        F.col("table_name"),
        F.col("column_name"),
        -F.coalesce("total_size_bytes", F.lit(0)),
        category=F.lit("Storage"),
        severity=F.when(share < config.high_column_model_pct, "WARNING").otherwise("ERROR"),
        impact_area=F.lit("MODEL_SIZE"),
        finding_text=F.lit(M.STORAGE_FINDING),
        recommended_action=M.storage_advice(F.col("data_type")),
        technical_evidence=M.storage_evidence(
            F.col("total_size_bytes"), F.col("model_size_pct"), F.col("cardinality")
        ),
        evidence_json=json_text(ranked, RAW),
        reclaimable_upper_bound_bytes=F.col("total_size_bytes"),
        change_risk=F.lit("HIGH"),
    )


def column_sizes(columns: DataFrame) -> DataFrame:
    """Size per model, table and column name without regard to case; the last of several rows wins."""
    return columns.groupBy(
        "model_id",
        F.lower(F.coalesce("table_name", F.lit(""))).alias("table_key"),
        F.lower(F.coalesce("column_name", F.lit(""))).alias("object_key"),
    ).agg(
        F.max_by(
            "total_size_bytes", F.struct("evidence_ordinal", "table_name", "column_name", "total_size_bytes")
        ).alias("known_size")
    )


def unused_findings(usage: DataFrame, columns: DataFrame, config: ScanConfig) -> DataFrame:
    """One finding per unused object, weighted by the storage size of the column of that name."""
    unused = (
        usage.filter(~F.col("is_used"))
        .withColumn("table_key", F.lower(F.coalesce("table_name", F.lit(""))))
        .withColumn("object_key", F.lower(F.coalesce("object_name", F.lit(""))))
        .join(column_sizes(columns), ["model_id", "table_key", "object_key"], "left")
    )
    large = F.col("known_size") >= config.min_column_size_mb * 1024 * 1024
    monitored = config.usage_method == USAGE_METHOD_MONITORING
    return finding_rows(
        unused,
        config,
        "UNUSED_OBJECT_ANALYSIS",
        F.lit("Unused semantic model object"),
        F.col("object_type"),
        F.col("table_name"),
        F.col("object_name"),
        F.col("evidence_ordinal"),
        category=F.lit("Usage"),
        severity=F.when(large, "WARNING").otherwise("INFO"),
        impact_area=F.when(F.lower("object_type").isin("column", "table"), "MODEL_SIZE").otherwise("MAINTAINABILITY"),
        finding_text=F.lit(M.UNUSED_FINDING),
        recommended_action=F.lit(M.UNUSED_ACTION),
        technical_evidence=F.lit(M.usage_evidence(monitored, config.usage_window_days)),
        evidence_json=F.col("raw_json"),
        reclaimable_upper_bound_bytes=F.col("known_size"),
        change_risk=F.lit("HIGH"),
    )


def fallback_findings(checks: DataFrame, config: ScanConfig) -> DataFrame:
    """One finding per fallback check with an issue."""
    return finding_rows(
        checks.filter(F.col("status") == "ISSUE"),
        config,
        "DIRECT_LAKE",
        F.lit("Direct Lake fallback risk"),
        F.lit("Table"),
        F.col("table_name"),
        F.col("table_name"),
        F.col("evidence_ordinal"),
        category=F.lit("Direct Lake"),
        severity=F.lit("WARNING"),
        confidence=F.lit("HIGH"),
        impact_area=F.lit("QUERY_CU"),
        finding_text=F.col("reason"),
        recommended_action=F.lit(M.FALLBACK_ACTION),
        technical_evidence=F.col("reason"),
        evidence_json=F.col("raw_json"),
    )
