"""Declared tables: columns, keys, slices and relationships."""

from pyspark.sql import types as T

# Column names and types of the stored tables. A trailing ! marks a required column.
_TECHNICAL = {
    "scan_run": (
        "scan_id! request_id! requested_by_upn auth_mode analysis_profile scanner_version solution_stage status "
        "started_at:timestamp completed_at:timestamp target_count:int success_count:int partial_count:int "
        "failed_count:int skipped_count:int semantic_link_version semantic_link_labs_version parameters_hash "
        "error_category error_message"
    ),
    "model_scan": (
        "scan_id! workspace_id! workspace_name model_id! model_name scope_source scanner_version solution_stage "
        "permission_precheck_status scanner_workspace_role permission_precheck_message capacity_id capacity_name "
        "storage_mode model_size_bytes:bigint overall_status bpa_status vpa_status refresh_status usage_status "
        "direct_lake_status access_snapshot_status finding_count:int started_at:timestamp completed_at:timestamp "
        "duration_seconds:double error_json"
    ),
    "finding": (
        "finding_id! scan_id! scanner_version solution_stage workspace_id workspace_name model_id model_name source "
        "category rule_id rule_name severity confidence impact_area object_type table_name object_name finding_text "
        "recommended_action technical_evidence evidence_json estimated_saving_bytes_low:bigint "
        "estimated_saving_bytes_high:bigint reclaimable_upper_bound_bytes:bigint cu_saving_status "
        "benefit_validation_status change_risk validation_required:boolean documentation_url detected_at:timestamp"
    ),
    "vpa_column": (
        "evidence_id! scan_id! workspace_id model_id table_name column_name data_type encoding cardinality:bigint "
        "data_size_bytes:bigint dictionary_size_bytes:bigint hierarchy_size_bytes:bigint total_size_bytes:bigint "
        "model_size_pct:double raw_json detected_at:timestamp"
    ),
    "vpa_table": (
        "evidence_id! scan_id! workspace_id model_id table_name row_count:bigint data_size_bytes:bigint "
        "dictionary_size_bytes:bigint hierarchy_size_bytes:bigint total_size_bytes:bigint model_size_pct:double "
        "raw_json detected_at:timestamp"
    ),
    "object_usage": (
        "usage_id! scan_id! workspace_id model_id table_name object_type object_name is_used:boolean "
        "usage_count:bigint usage_method usage_window_days:int raw_json detected_at:timestamp"
    ),
    "refresh": (
        "refresh_id! scan_id! workspace_id model_id request_id refresh_type status start_time:timestamp "
        "end_time:timestamp duration_seconds:double raw_json captured_at:timestamp"
    ),
    "direct_lake": (
        "check_id! scan_id! workspace_id model_id check_type table_name status reason raw_json detected_at:timestamp"
    ),
    "item_access_snapshot": (
        "access_id! scan_id! workspace_id model_id principal_id principal_name principal_type principal_upn "
        "permissions additional_permissions raw_json captured_at:timestamp"
    ),
    "model_access": (
        "access_key! workspace_id model_id principal_upn source is_active:boolean valid_from:timestamp "
        "valid_to:timestamp updated_by updated_at:timestamp"
    ),
    "dim_model": (
        "model_id! workspace_id workspace_name model_name capacity_id capacity_name storage_mode latest_scan_id "
        "last_scan_status last_scanned_at:timestamp"
    ),
}
_LINK = "analysis_id! semantic_model_id! opportunity_id! related_entity_id!"
_CURATED = {
    "overview": (
        "analysis_id! workspace_id workspace_name semantic_model_id! semantic_model_name storage_mode analysis_status "
        "analysis_completed_at:timestamp scanner_version semantic_model_size_bytes:bigint "
        "optimization_opportunity_count:int optimization_recommendation_count:int optimization_finding_count:int "
        "high_severity_finding_count:int best_practice_analysis_status storage_analysis_status refresh_history_status "
        "refresh_history_record_count:int object_usage_analysis_status object_usage_observation_count:int "
        "direct_lake_analysis_status direct_lake_observation_count:int item_access_snapshot_status "
        "item_access_record_count:int data_availability_explanation"
    ),
    "opportunities": (
        "opportunity_id! analysis_id! workspace_name semantic_model_id! semantic_model_name opportunity_title "
        "optimization_domain finding_source highest_severity finding_count:int recommendation_count:int "
        "estimated_saving_bytes_low:bigint estimated_saving_bytes_high:bigint change_risk opportunity_summary "
        "priority_score:int detected_at:timestamp"
    ),
    "recommendations": (
        "recommendation_id! analysis_id! workspace_name semantic_model_id! semantic_model_name recommendation_title "
        "optimization_domain recommended_action change_risk validation_required:boolean "
        "estimated_saving_bytes_low:bigint estimated_saving_bytes_high:bigint finding_source "
        "affected_finding_count:int detected_at:timestamp"
    ),
    "findings": (
        "finding_id! analysis_id! workspace_name semantic_model_id! semantic_model_name finding_source "
        "optimization_domain rule_name severity confidence impact_area affected_object_type affected_table_name "
        "affected_object_name finding_description recommended_action technical_evidence "
        "estimated_saving_bytes_low:bigint estimated_saving_bytes_high:bigint change_risk "
        "validation_required:boolean detected_at:timestamp"
    ),
    "opportunity_recommendation_links": _LINK,
    "opportunity_finding_links": _LINK,
    "column_storage": (
        "column_storage_record_id! analysis_id! workspace_name semantic_model_id! semantic_model_name table_name "
        "column_name data_type encoding cardinality:bigint data_size_bytes:bigint dictionary_size_bytes:bigint "
        "hierarchy_size_bytes:bigint total_size_bytes:bigint percentage_of_semantic_model_size:double "
        "detected_at:timestamp"
    ),
}

TECHNICAL_KEYS = {
    "scan_run": ["scan_id"],
    "model_scan": ["scan_id", "model_id"],
    "finding": ["finding_id"],
    "vpa_column": ["evidence_id"],
    "vpa_table": ["evidence_id"],
    "object_usage": ["usage_id"],
    "refresh": ["refresh_id"],
    "direct_lake": ["check_id"],
    "item_access_snapshot": ["access_id"],
    "model_access": ["access_key"],
    "dim_model": ["model_id"],
}
CURATED_KEYS = {
    "overview": ["semantic_model_id"],
    "opportunities": ["opportunity_id"],
    "recommendations": ["recommendation_id"],
    "findings": ["finding_id"],
    "column_storage": ["column_storage_record_id"],
}
SLICE_COLUMN = "semantic_model_id"

# Namespaces, and where each current-state table lives.
HISTORY_SCHEMA = "model_history"
HISTORY_PREFIX = "history_"
BUSINESS_SCHEMAS = [
    "analysis_control",
    "semantic_model_metadata",
    "semantic_model_vertipaq",
    "semantic_model_best_practice",
    "semantic_model_optimization",
]
CURATED_NAMES = {
    "overview": "semantic_model_optimization.semantic_model_optimization_overview",
    "opportunities": "semantic_model_optimization.semantic_model_optimization_opportunities",
    "recommendations": "semantic_model_optimization.semantic_model_optimization_recommendations",
    "findings": "semantic_model_optimization.semantic_model_optimization_findings",
    "opportunity_recommendation_links": (
        "semantic_model_optimization.semantic_model_optimization_opportunity_recommendation_links"
    ),
    "opportunity_finding_links": (
        "semantic_model_optimization.semantic_model_optimization_opportunity_finding_links"
    ),
    "column_storage": "semantic_model_vertipaq.semantic_model_column_storage",
}

# Which publication of each model is current.
POINTER_TABLE = "semantic_model_optimization.current_publications"

# child table, child column, parent table, parent column (many to one).
RELATIONSHIPS = [
    ("opportunities", "semantic_model_id", "overview", "semantic_model_id"),
    ("recommendations", "semantic_model_id", "overview", "semantic_model_id"),
    ("findings", "semantic_model_id", "overview", "semantic_model_id"),
    ("column_storage", "semantic_model_id", "overview", "semantic_model_id"),
    ("opportunity_recommendation_links", "opportunity_id", "opportunities", "opportunity_id"),
    ("opportunity_finding_links", "opportunity_id", "opportunities", "opportunity_id"),
]


def _struct(spec: str) -> T.StructType:
    fields = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        fields.append((name.rstrip("!"), kind or "string", not name.endswith("!")))
    ddl = ", ".join(f"{n} {k}{'' if nullable else ' NOT NULL'}" for n, k, nullable in fields)
    return T.StructType.fromDDL(ddl)


def technical_schema(name: str) -> T.StructType:
    return _struct(_TECHNICAL[name])


def curated_schema(name: str) -> T.StructType:
    return _struct(_CURATED[name])


TECHNICAL_TABLES = list(_TECHNICAL)
CURATED_TABLES = list(_CURATED)
