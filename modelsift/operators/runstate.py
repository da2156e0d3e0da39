"""Stage outcomes, model rows and the run row."""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsift.config import CORE_STAGES, STAGE_LABEL, STAGES, VERSION, ScanConfig
from modelsift.functions.messages import error_category, is_direct_lake
from modelsift.functions.text import error_text, stable_id

GATED = "SKIPPED_PERMISSION"
GATED_ACCESS = "NOT_RUN_PERMISSION_PRECHECK"
GATED_MESSAGE = "SPN workspace permission precheck did not pass."
CURATED_STATUSES = ["SUCCEEDED", "PARTIAL"]

# Collectors whose failures are recorded on the model row: the stages and two model attributes.
ERROR_KEYS = ("capacity", "model_size", *STAGES)


def error_columns(stage_errors: DataFrame) -> DataFrame:
    """One row per model, one column per collector with its error message."""
    return stage_errors.groupBy(F.lower("model_id").alias("model_id")).agg(
        *[F.min(F.when(F.col("stage") == k, F.col("message"))).alias(f"{k}_error") for k in ERROR_KEYS]
    )


UNCOLLECTED = "NOT_RUN"
NO_MESSAGE = "No message."
NO_OUTCOME = "The stage has no landed outcome."


def outcome_columns(outcomes: DataFrame) -> DataFrame:
    """From landed outcomes: one row per model, per collector whether one was landed and the message of a failure.

    Of several outcomes of a stage a failure counts, of several failures the least message.
    """
    def of(k: str) -> Column:
        return F.col("stage") == k

    failure = F.when(F.col("status") == "FAILED", F.coalesce("message", F.lit(NO_MESSAGE)))
    return outcomes.groupBy(F.lower("model_id").alias("model_id")).agg(
        *[F.min(F.when(of(k), failure)).alias(f"{k}_error") for k in ERROR_KEYS],
        *[F.max(of(k) & F.col("status").isin("SUCCEEDED", "FAILED")).alias(f"{k}_landed") for k in STAGES],
    )


def error_document(errors: dict[str, Column]) -> Column:
    """Collector -> message as JSON with sorted keys; null when nothing failed."""
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), errors[k].alias("value")) for k in sorted(errors)]),
        lambda e: e["value"].isNotNull(),
    )
    return F.when(F.size(entries) > 0, F.to_json(F.map_from_entries(entries)))


def is_gated(config: ScanConfig) -> Column:
    if not config.gate_enforced:
        return F.lit(False)
    return F.coalesce(F.col("permission_precheck_status") != "PASSED", F.lit(True))


def one_value(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """One attribute row per id, ids without regard to case: the greatest of several."""
    greatest = F.max(F.struct(*values)).alias("_value")
    return rows.groupBy(F.lower(key).alias(key)).agg(greatest).select(key, *[f"_value.{v}" for v in values])


def model_states(
    targets: DataFrame,
    stage_errors: DataFrame,
    modes: DataFrame,
    sizes: DataFrame,
    capacity: DataFrame,
    config: ScanConfig,
    outcomes: DataFrame | None = None,
) -> DataFrame:
    """One row per target: attributes, stage statuses, overall status and error document.

    With landed outcomes, a stage has run if its outcome says so; a model with an enabled stage that has none is
    NOT_RUN as a whole, so nothing of it is published, and its error document names those stages. Without them, a
    stage has run unless stage_errors has a row.
    """
    reported = error_columns(stage_errors) if outcomes is None else outcome_columns(outcomes)
    joined = (
        targets.join(reported, "model_id", "left")
        .join(modes.withColumnRenamed("storage_mode", "_mode"), "model_id", "left")
        .join(one_value(sizes, "model_id", "model_size_bytes").withColumnRenamed("model_size_bytes", "_size"), "model_id", "left")
        .join(one_value(capacity, "workspace_id", "capacity_id", "capacity_name"), "workspace_id", "left")
        .withColumn("gated", is_gated(config))
    )
    gated = F.col("gated")
    failed = {k: F.col(f"{k}_error").isNotNull() for k in ERROR_KEYS}

    def collected(stage: str) -> Column:
        return F.lit(True) if outcomes is None else F.coalesce(F.col(f"{stage}_landed"), F.lit(False))

    def attribute(name: str, collector: str) -> Column:
        return F.when(~gated & ~failed[collector], F.col(name))

    storage_read = ~gated & ~failed["vpa"] & collected("vpa") if config.enabled("vpa") else F.lit(False)
    mode = F.coalesce(F.when(storage_read, F.col("_mode")), F.lit("UNKNOWN"))
    joined = joined.withColumn("storage_mode", mode)

    def status(stage: str) -> Column:
        if not config.enabled(stage):
            ran = F.lit("NOT_RUN")
        else:
            ran = F.when(failed[stage], "FAILED").when(collected(stage), "SUCCEEDED").otherwise(UNCOLLECTED)
            if stage == "direct_lake":
                ran = F.when(is_direct_lake(F.col("storage_mode")), ran).otherwise("NOT_APPLICABLE")
        if stage == "access_snapshot":
            return F.when(gated, GATED_ACCESS).otherwise(ran)
        return F.when(gated, GATED if config.enabled(stage) else "NOT_RUN").otherwise(ran)

    joined = joined.select("*", *[status(s).alias(f"{s}_status") for s in STAGES])

    core_failed = F.lit(True)
    for stage in CORE_STAGES:
        if config.enabled(stage):
            core_failed = core_failed & (F.col(f"{stage}_status") == "FAILED")
    any_failed = F.lit(False)
    for stage in STAGES:
        any_failed = any_failed | (F.col(f"{stage}_status") == "FAILED")
    missing = F.lit(False)
    for stage in STAGES:
        if config.enabled(stage):
            missing = missing | (F.col(f"{stage}_status") == UNCOLLECTED)
    overall = (
        F.when(gated, GATED).when(missing, UNCOLLECTED).when(core_failed, "FAILED").when(any_failed, "PARTIAL").otherwise("SUCCEEDED")
    )
    message = F.when(gated, F.coalesce("permission_precheck_message", F.lit(GATED_MESSAGE))).otherwise(
        F.col("permission_precheck_message")
    )
    # A collector that did not run leaves no error.
    errors = {}
    for key in ERROR_KEYS:
        if key in STAGES:
            errors[key] = F.when(F.col(f"{key}_status") == "FAILED", F.col(f"{key}_error"))
            if outcomes is not None and config.enabled(key):
                absent = F.when(F.col(f"{key}_status") == UNCOLLECTED, F.lit(NO_OUTCOME))
                errors[key] = F.coalesce(errors[key], absent)
        else:
            errors[key] = F.col(f"{key}_error")
    gate_error = F.to_json(F.struct(message.alias("permission_precheck")))
    started, completed = F.lit(config.started_at), F.lit(config.completed_at)
    return joined.select(
        F.lit(config.scan_id).alias("scan_id"),
        "workspace_id",
        "workspace_name",
        "model_id",
        "model_name",
        "scope_source",
        F.lit(VERSION).alias("scanner_version"),
        F.lit(STAGE_LABEL).alias("solution_stage"),
        "permission_precheck_status",
        "scanner_workspace_role",
        message.alias("permission_precheck_message"),
        attribute("capacity_id", "capacity").alias("capacity_id"),
        attribute("capacity_name", "capacity").alias("capacity_name"),
        "storage_mode",
        attribute("_size", "model_size").cast("bigint").alias("model_size_bytes"),
        overall.alias("overall_status"),
        *[f"{s}_status" for s in STAGES],
        started.cast("timestamp").alias("started_at"),
        completed.cast("timestamp").alias("completed_at"),
        F.lit((config.completed_at - config.started_at).total_seconds()).alias("duration_seconds"),
        F.when(gated, gate_error).otherwise(error_document(errors)).alias("error_json"),
    )


def model_rows(states: DataFrame, finding_counts: DataFrame) -> DataFrame:
    """Model states with their number of findings."""
    columns = list(states.columns)
    at = columns.index("started_at")
    return states.join(finding_counts, "model_id", "left").select(
        *columns[:at],
        F.coalesce("finding_count", F.lit(0)).cast("int").alias("finding_count"),
        *columns[at:],
    )


def dim_rows(states: DataFrame) -> DataFrame:
    return states.select(
        "model_id",
        "workspace_id",
        "workspace_name",
        "model_name",
        "capacity_id",
        "capacity_name",
        "storage_mode",
        F.col("scan_id").alias("latest_scan_id"),
        F.col("overall_status").alias("last_scan_status"),
        F.col("completed_at").alias("last_scanned_at"),
    )


def parameters_hash(config: ScanConfig) -> Column:
    """Id of the run's settings: their JSON with sorted keys."""
    return stable_id(json.dumps(config.safe_parameters(), sort_keys=True, ensure_ascii=False))


def status_counts() -> list[Column]:
    count = lambda s: F.count_if(F.col("overall_status") == s).cast("int")
    return [
        F.count(F.lit(1)).cast("int").alias("target_count"),
        F.count_distinct("workspace_id").cast("int").alias("workspace_count"),
        count("SUCCEEDED").alias("success_count"),
        count("PARTIAL").alias("partial_count"),
        F.count_if(F.col("overall_status").isin("FAILED", UNCOLLECTED)).cast("int").alias("failed_count"),
        count(GATED).alias("skipped_count"),
    ]


def run_row(
    states: DataFrame, config: ScanConfig, initialize_only: bool = False, error: tuple[str, str] | None = None
) -> DataFrame:
    """The run's final row, from the statuses of its models. error is (type, message) of a run failure."""
    return finish_run(states.agg(*status_counts()), config, initialize_only, error)


def unscanned(targets: DataFrame) -> DataFrame:
    """Counts of a run none of whose targets has been scanned."""
    zero = F.lit(0)
    return targets.agg(F.count(F.lit(1)).cast("int").alias("target_count")).select(
        "target_count", *[zero.alias(f"{s}_count") for s in ("workspace", "success", "partial", "failed", "skipped")]
    )


def running_row(targets: DataFrame, config: ScanConfig) -> DataFrame:
    """The run's row before any model is scanned."""
    row = finish_run(unscanned(targets), config)
    return row.withColumns(
        {
            "status": F.lit("RUNNING"),
            "completed_at": F.lit(None).cast("timestamp"),
            "error_category": F.lit(None).cast("string"),
            "error_message": F.lit(None).cast("string"),
        }
    )


def finish_run(
    counts: DataFrame, config: ScanConfig, initialize_only: bool = False, error: tuple[str, str] | None = None
) -> DataFrame:
    any_failed = F.col("failed_count") > 0
    any_skipped = F.col("skipped_count") > 0
    blocked = any_skipped & F.lit(config.fail_on_skipped_model)
    if initialize_only:
        status = F.lit("INITIALIZED")
    elif error is not None:
        status = F.lit("FAILED")
    else:
        status = (
            F.when(any_failed & F.lit(config.fail_on_failed_model), "FAILED")
            .when(blocked, "FAILED")
            .when(any_skipped & (F.col("skipped_count") == F.col("target_count")), GATED)
            .when(any_failed | any_skipped | (F.col("partial_count") > 0), "PARTIAL")
            .otherwise("SUCCEEDED")
        )
    if error is not None:
        category = error_category(F.lit(error[1]))
        message = error_text(F.lit(error[0]), F.lit(error[1]))
    else:
        category = F.when(blocked, "AUTHORIZATION")
        message = F.when(
            blocked,
            F.concat(
                F.col("skipped_count").cast("string"),
                F.lit(" model(s) skipped because the SPN workspace access precheck did not pass."),
            ),
        )
    more = [c for c in counts.columns if not c.endswith("_count")]
    return counts.select(
        F.lit(config.scan_id).alias("scan_id"),
        F.lit(config.effective_request_id).alias("request_id"),
        F.lit(config.requester).cast("string").alias("requested_by_upn"),
        F.lit(config.auth_mode).alias("auth_mode"),
        F.lit(config.profile).alias("analysis_profile"),
        F.lit(VERSION).alias("scanner_version"),
        F.lit(STAGE_LABEL).alias("solution_stage"),
        status.alias("status"),
        F.lit(config.started_at).cast("timestamp").alias("started_at"),
        F.lit(config.completed_at).cast("timestamp").alias("completed_at"),
        "target_count",
        "success_count",
        "partial_count",
        "failed_count",
        "skipped_count",
        F.lit(config.component_versions.get("semantic_link", "UNKNOWN")).alias("semantic_link_version"),
        F.lit(config.component_versions.get("semantic_link_labs", "UNKNOWN")).alias("semantic_link_labs_version"),
        parameters_hash(config).alias("parameters_hash"),
        category.cast("string").alias("error_category"),
        message.cast("string").alias("error_message"),
        "workspace_count",
        *more,
    )


def run_summary(states: DataFrame, config: ScanConfig, error: tuple[str, str] | None = None) -> DataFrame:
    """One JSON document: the run's counts and one entry per model.

    All entries are in one row, which one task builds; without max_models_per_run nothing bounds it. A run
    returns run_header instead, and its models are rows of model_scan.
    """
    entry = F.struct(
        "workspace_id",
        "model_id",
        "model_name",
        F.col("overall_status").alias("status"),
        "permission_precheck_status",
        "scanner_workspace_role",
        "finding_count",
    )
    counts = states.agg(*status_counts(), F.array_sort(F.collect_list(entry)).alias("model_results"))
    return _summary_json(counts, config, error)


def run_header(states: DataFrame, config: ScanConfig, error: tuple[str, str] | None = None) -> DataFrame:
    """The summary's JSON document without the entries per model, by a plain aggregate."""
    return _summary_json(states.agg(*status_counts()), config, error)


def _summary_json(counts: DataFrame, config: ScanConfig, error: tuple[str, str] | None) -> DataFrame:
    seconds = (config.completed_at - config.started_at).total_seconds()
    failure = error_text(F.lit(error[0]), F.lit(error[1])) if error else F.lit(None).cast("string")
    return finish_run(counts, config, error=error).select(
        "scan_id",
        F.to_json(
            F.struct(
                "scan_id",
                "request_id",
                "status",
                "target_count",
                "success_count",
                "partial_count",
                "failed_count",
                "skipped_count",
                F.round(F.lit(float(seconds)), 2).alias("duration_seconds"),
                *[c for c in counts.columns if not c.endswith("_count")],
                failure.alias("error"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("summary_json"),
    )
