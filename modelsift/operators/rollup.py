"""Findings of usable analyses -> opportunities, recommendations, links and the model overview.

All rollups come from one aggregate of the findings at the grain where severity, risk, rule and
action are still separate (finding_groups). That is the only shuffle that grows with the findings;
its keys are few per model and its buffers are plain numbers, so every task combines its rows by
hash first and a model with a third of all findings sends no more rows than any other.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsift.functions import messages as M
from modelsift.functions.text import blank_to_null, stable_id
from modelsift.functions.values import is_high_severity, risk_rank, severity_rank
from modelsift.operators.ranking import by_key_hash, union_all
from modelsift.operators.runstate import CURATED_STATUSES

DEFAULT_DOMAIN = "General optimization"
DEFAULT_SOURCE = "Unknown source"
DEFAULT_TITLE = "Optimization recommendation"


def curated_models(states: DataFrame) -> DataFrame:
    """Models whose analysis replaces their current state."""
    return states.filter(F.col("overall_status").isin(CURATED_STATUSES))


def _domain() -> Column:
    return F.coalesce(
        blank_to_null(F.col("category")), blank_to_null(F.col("impact_area")), F.lit(DEFAULT_DOMAIN)
    )


def _source() -> Column:
    return F.coalesce(blank_to_null(F.col("source")), F.lit(DEFAULT_SOURCE))


def _opportunity_id() -> Column:
    return stable_id(F.col("semantic_model_id"), "OPPORTUNITY", F.col("finding_source"), F.col("optimization_domain"))


def _recommendation_id() -> Column:
    rule = F.coalesce(blank_to_null(F.col("rule_id")), F.col("rule_name"))
    return stable_id(F.col("semantic_model_id"), "RECOMMENDATION", rule, F.col("recommended_action"))


def keyed(findings: DataFrame) -> DataFrame:
    """Findings with the names of the curated layer and their rollup attributes."""
    return findings.withColumns(
        {"finding_source": _source(), "optimization_domain": _domain(), "semantic_model_id": F.col("model_id")}
    )


def finding_groups(findings: DataFrame) -> DataFrame:
    """Pre-aggregate shared by all rollups."""
    ordinal = F.col("evidence_ordinal")
    return (
        keyed(findings)
        .groupBy(
            "semantic_model_id",
            "finding_source",
            "optimization_domain",
            "source_rank",
            "rule_id",
            "rule_name",
            "recommended_action",
            "severity",
            "change_risk",
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(ordinal).alias("first_ordinal"),
            F.sum(F.coalesce("estimated_saving_bytes_low", F.lit(0))).alias("saving_low"),
            F.sum(F.coalesce("estimated_saving_bytes_high", F.lit(0))).alias("saving_high"),
            F.sum("estimated_saving_bytes_low").alias("known_saving_low"),
            F.sum("estimated_saving_bytes_high").alias("known_saving_high"),
            F.max("detected_at").alias("detected_at"),
            F.max(F.coalesce("validation_required", F.lit(False))).alias("validation_required"),
        )
        .withColumns({"opportunity_id": _opportunity_id(), "recommendation_id": _recommendation_id()})
    )


def linked_findings(findings: DataFrame) -> DataFrame:
    """(opportunity_id, finding_id, rule_name, link_count): the findings of each opportunity, one row per finding id.

    A finding that is alone with its id is its own row; only the others are shuffled to be counted.
    """
    shown = ["opportunity_id", "finding_id", "rule_name"]
    alone, others, _ = by_key_hash(findings, ["finding_id"])
    parts = []
    if alone is not None:
        parts.append(_with_opportunity(alone).select(*shown, F.lit(1).cast("bigint").alias("link_count")))
    if others is not None:
        parts.append(_with_opportunity(others).groupBy(*shown).agg(F.count(F.lit(1)).alias("link_count")))
    return union_all(parts)


def _with_opportunity(findings: DataFrame) -> DataFrame:
    return keyed(findings).withColumn("opportunity_id", _opportunity_id())


def _seen() -> Column:
    """Order of first sight; equal ordinals are settled by the group's own values."""
    return F.struct(
        "source_rank",
        "first_ordinal",
        "optimization_domain",
        "finding_source",
        "rule_name",
        "recommended_action",
        "severity",
        "change_risk",
    )


def _top(label: str, rank: Column) -> Column:
    """Label of the highest rank, the first seen among equals."""
    return F.min_by(label, F.struct(-rank, _seen()))


def opportunities(groups: DataFrame, models: DataFrame) -> DataFrame:
    rolled = groups.groupBy("semantic_model_id", "opportunity_id").agg(
        F.min_by("optimization_domain", _seen()).alias("optimization_domain"),
        F.min_by("finding_source", _seen()).alias("finding_source"),
        _top("severity", severity_rank(F.col("severity"))).alias("highest_severity"),
        F.sum("n").alias("n"),
        F.count_distinct("recommendation_id").cast("int").alias("recommendation_count"),
        F.sum("saving_low").alias("estimated_saving_bytes_low"),
        F.sum("saving_high").alias("estimated_saving_bytes_high"),
        _top("change_risk", risk_rank(F.col("change_risk"))).alias("change_risk"),
        F.max("detected_at").alias("detected_at"),
    )
    domain = F.col("optimization_domain")
    return named(rolled, models).select(
        "opportunity_id",
        "analysis_id",
        "workspace_name",
        "semantic_model_id",
        "semantic_model_name",
        M.opportunity_title(domain).alias("opportunity_title"),
        "optimization_domain",
        "finding_source",
        "highest_severity",
        F.col("n").cast("int").alias("finding_count"),
        "recommendation_count",
        "estimated_saving_bytes_low",
        "estimated_saving_bytes_high",
        "change_risk",
        M.opportunity_summary(F.col("n"), F.col("finding_source"), domain).alias("opportunity_summary"),
        (severity_rank(F.col("highest_severity")) * 100 + F.least(F.col("n"), F.lit(99)))
        .cast("int")
        .alias("priority_score"),
        "detected_at",
    )


def recommendations(groups: DataFrame, models: DataFrame) -> DataFrame:
    title = F.coalesce(blank_to_null(F.col("rule_name")), F.lit(DEFAULT_TITLE))
    rolled = groups.groupBy("semantic_model_id", "recommendation_id").agg(
        F.min_by(title, _seen()).alias("recommendation_title"),
        F.min_by("optimization_domain", _seen()).alias("optimization_domain"),
        F.min_by("recommended_action", _seen()).alias("recommended_action"),
        _top("change_risk", risk_rank(F.col("change_risk"))).alias("change_risk"),
        F.bool_or("validation_required").alias("validation_required"),
        F.sum("saving_low").alias("estimated_saving_bytes_low"),
        F.sum("saving_high").alias("estimated_saving_bytes_high"),
        F.min_by("finding_source", _seen()).alias("finding_source"),
        F.sum("n").cast("int").alias("affected_finding_count"),
        F.max("detected_at").alias("detected_at"),
    )
    return named(rolled, models).select(
        "recommendation_id",
        "analysis_id",
        "workspace_name",
        "semantic_model_id",
        "semantic_model_name",
        "recommendation_title",
        "optimization_domain",
        "recommended_action",
        "change_risk",
        "validation_required",
        "estimated_saving_bytes_low",
        "estimated_saving_bytes_high",
        "finding_source",
        "affected_finding_count",
        "detected_at",
    )


def named(rolled: DataFrame, models: DataFrame) -> DataFrame:
    """Attach analysis, workspace and model names."""
    names = models.select(
        F.col("model_id").alias("semantic_model_id"),
        F.col("scan_id").alias("analysis_id"),
        "workspace_name",
        F.col("model_name").alias("semantic_model_name"),
    )
    return rolled.join(names, "semantic_model_id")


def recommendation_links(groups: DataFrame, analysis_id: str) -> DataFrame:
    """Distinct pairs."""
    return groups.select(
        F.lit(analysis_id).alias("analysis_id"),
        "semantic_model_id",
        "opportunity_id",
        F.col("recommendation_id").alias("related_entity_id"),
    ).distinct()


def finding_links(findings: DataFrame, analysis_id: str) -> DataFrame:
    """One row per finding row."""
    return keyed(findings).select(
        F.lit(analysis_id).alias("analysis_id"),
        "semantic_model_id",
        _opportunity_id().alias("opportunity_id"),
        F.col("finding_id").alias("related_entity_id"),
    )


def curated_findings(findings: DataFrame) -> DataFrame:
    return keyed(findings).select(
        "finding_id",
        F.col("scan_id").alias("analysis_id"),
        "workspace_name",
        "semantic_model_id",
        F.col("model_name").alias("semantic_model_name"),
        "finding_source",
        "optimization_domain",
        "rule_name",
        "severity",
        "confidence",
        "impact_area",
        F.col("object_type").alias("affected_object_type"),
        F.col("table_name").alias("affected_table_name"),
        F.col("object_name").alias("affected_object_name"),
        F.col("finding_text").alias("finding_description"),
        "recommended_action",
        "technical_evidence",
        "estimated_saving_bytes_low",
        "estimated_saving_bytes_high",
        "change_risk",
        "validation_required",
        "detected_at",
    )


def column_storage(columns: DataFrame) -> DataFrame:
    return columns.select(
        F.col("evidence_id").alias("column_storage_record_id"),
        F.col("scan_id").alias("analysis_id"),
        "workspace_name",
        F.col("model_id").alias("semantic_model_id"),
        F.col("model_name").alias("semantic_model_name"),
        "table_name",
        "column_name",
        "data_type",
        "encoding",
        "cardinality",
        "data_size_bytes",
        "dictionary_size_bytes",
        "hierarchy_size_bytes",
        "total_size_bytes",
        F.col("model_size_pct").alias("percentage_of_semantic_model_size"),
        "detected_at",
    )


def group_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy(F.col("semantic_model_id").alias("model_id")).agg(
        F.count_distinct("opportunity_id").alias("opportunity_count"),
        F.count_distinct("recommendation_id").alias("recommendation_count"),
        F.sum("n").alias("finding_count"),
        F.sum(F.when(is_high_severity(F.col("severity")), F.col("n")).otherwise(F.lit(0))).alias("high_count"),
    )


def row_counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("model_id").agg(F.count(F.lit(1)).alias(name))


def overview(models: DataFrame, counts: list[DataFrame]) -> DataFrame:
    """One row per usable analysis. counts hold one row per model each."""
    joined = models
    for frame in counts:
        joined = joined.join(frame, "model_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    refresh, usage = n("refresh_count"), n("usage_count")
    direct_lake, access = n("direct_lake_count"), n("access_count")
    return joined.select(
        F.col("scan_id").alias("analysis_id"),
        "workspace_id",
        "workspace_name",
        F.col("model_id").alias("semantic_model_id"),
        F.col("model_name").alias("semantic_model_name"),
        "storage_mode",
        F.col("overall_status").alias("analysis_status"),
        F.col("completed_at").alias("analysis_completed_at"),
        "scanner_version",
        F.col("model_size_bytes").alias("semantic_model_size_bytes"),
        n("opportunity_count").alias("optimization_opportunity_count"),
        n("recommendation_count").alias("optimization_recommendation_count"),
        n("finding_count").alias("optimization_finding_count"),
        n("high_count").alias("high_severity_finding_count"),
        F.col("bpa_status").alias("best_practice_analysis_status"),
        F.col("vpa_status").alias("storage_analysis_status"),
        F.col("refresh_status").alias("refresh_history_status"),
        refresh.alias("refresh_history_record_count"),
        F.col("usage_status").alias("object_usage_analysis_status"),
        usage.alias("object_usage_observation_count"),
        F.col("direct_lake_status").alias("direct_lake_analysis_status"),
        direct_lake.alias("direct_lake_observation_count"),
        F.col("access_snapshot_status").alias("item_access_snapshot_status"),
        access.alias("item_access_record_count"),
        M.availability_note(
            F.col("refresh_status"),
            refresh,
            F.col("usage_status"),
            usage,
            F.col("direct_lake_status"),
            direct_lake,
            F.col("access_snapshot_status"),
            access,
        ).alias("data_availability_explanation"),
    )
