"""Which models a run covers: workspace precheck, scope, exclusions and safeguards."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.config import OPEN_PRECHECK_STATUSES, ScanConfig, guids_of
from modelsift.functions.text import blank_to_null, guids_in, strip
from modelsift.operators.ranking import top_per_group
from modelsift.sources import landing

# Principal types that can be the scanner.
SCANNER_PRINCIPAL_TYPES = ["serviceprincipal", "app", "serviceprincipalprofile"]
USER_MODE_MESSAGE = "User-mode scans rely on runtime authorization."
DISABLED_MESSAGE = "SPN precheck is disabled."
NO_SCANNER_ID_MESSAGE = (
    "Provide spn_object_id, or provide spn_client_id directly instead of only a Key Vault reference."
)
NOT_FOUND_MESSAGE = "The scanner SPN was not found as a direct principal in the target workspace."

TARGET_COLUMNS = [
    "workspace_id",
    "workspace_name",
    "model_id",
    "model_name",
    "scope_source",
    "permission_precheck_status",
    "scanner_workspace_role",
    "permission_precheck_message",
]


class ScopeError(ValueError):
    """The requested scope cannot be scanned."""


def scope_frame(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """Requested workspaces, in the order given. A job parameter, so its size is the caller's."""
    return guid_table(spark, config.scope_workspaces, "scope_order", "workspace_id")


def guid_table(spark: SparkSession, guids: tuple[str, ...], order: str, name: str) -> DataFrame:
    """Checked GUIDs of a job parameter as an inline table."""
    values = ", ".join(f"({i}, '{g}')" for i, g in enumerate(guids))
    return spark.sql(f"SELECT col1 AS {order}, col2 AS {name} FROM VALUES {values}")


def workspace_precheck(
    scope: DataFrame, access: DataFrame | None, config: ScanConfig, errors: DataFrame | None = None
) -> DataFrame:
    """One row per workspace: may the scanner read it, as which role, and why not."""
    if not config.gate_enforced:
        status = "NOT_CHECKED_USER_MODE" if config.user_mode else "NOT_ENFORCED"
        message = USER_MODE_MESSAGE if config.user_mode else DISABLED_MESSAGE
        return scope.select(
            "workspace_id",
            F.lit(status).alias("permission_precheck_status"),
            F.lit(None).cast("string").alias("access_workspace_name"),
            F.lit(None).cast("string").alias("scanner_workspace_role"),
            F.lit(message).alias("permission_precheck_message"),
        )
    scanner_ids = guids_of(config.scanner_object_id, config.scanner_client_id)
    if not scanner_ids:
        return scope.select(
            "workspace_id",
            F.lit("FAILED_SCANNER_ID_REQUIRED").alias("permission_precheck_status"),
            F.lit(None).cast("string").alias("access_workspace_name"),
            F.lit(None).cast("string").alias("scanner_workspace_role"),
            F.lit(NO_SCANNER_ID_MESSAGE).alias("permission_precheck_message"),
        )

    if access is None:  # nothing was landed to check against: closed, as after any other failed look
        return scope.select(
            "workspace_id",
            F.lit("ERROR").alias("permission_precheck_status"),
            F.lit(None).cast("string").alias("access_workspace_name"),
            F.lit(None).cast("string").alias("scanner_workspace_role"),
            F.lit("No workspace access was landed, so the scanner's role is unknown.").alias(
                "permission_precheck_message"
            ),
        )

    rows = landing.evidence(access, "workspace_access", raw=False)
    ordinal = F.col("source_ordinal") if "source_ordinal" in access.columns else F.lit(0)
    # The row order decides which of several matching principals counts.
    order = F.struct(ordinal, "principal_id", "principal_type", "workspace_role")
    kind = F.lower(F.replace(F.coalesce("principal_type", F.lit("")), F.lit(" "), F.lit("")))
    rows = rows.withColumn("_order", order).withColumn(
        "_match",
        kind.isin(SCANNER_PRINCIPAL_TYPES)
        & F.arrays_overlap(
            guids_in("principal_id", "principal_details"), F.array(*[F.lit(i) for i in scanner_ids])
        ),
    )
    # Aggregates keep one candidate per task, so a workspace with very many principals is no hot spot.
    per_workspace = rows.groupBy(F.lower("workspace_id").alias("workspace_id")).agg(
        F.min(F.when(F.col("_match"), F.struct("_order", "workspace_role"))).alias("first_match"),
        F.min(
            F.when(F.col("workspace_name").isNotNull(), F.struct("_order", "workspace_name"))
        ).alias("first_name"),
    )
    joined = scope.join(per_workspace, "workspace_id", "left")
    if errors is not None:
        failed = errors.groupBy(F.lower("workspace_id").alias("workspace_id")).agg(F.min("message").alias("_error"))
        joined = joined.join(failed, "workspace_id", "left")
    else:
        joined = joined.withColumn("_error", F.lit(None).cast("string"))

    role = F.col("first_match.workspace_role")
    accepted = F.coalesce(F.upper(strip(role)).isin(config.roles), F.lit(False))
    failed = F.col("_error").isNotNull()
    missing = F.col("first_match").isNull()
    roles_text = "[" + ", ".join(f"'{r}'" for r in config.roles) + "]"
    # A name counts only when it is seen no later than the matching principal.
    named = F.col("first_match").isNull() | (F.col("first_name._order") <= F.col("first_match._order"))
    return joined.select(
        "workspace_id",
        F.when(failed, "ERROR")
        .when(missing, "FAILED_NOT_IN_WORKSPACE")
        .when(accepted, "PASSED")
        .otherwise("FAILED_INSUFFICIENT_ROLE")
        .alias("permission_precheck_status"),
        F.when(~failed & named, F.col("first_name.workspace_name")).alias("access_workspace_name"),
        F.when(~failed, role).alias("scanner_workspace_role"),
        F.when(failed, F.concat(F.lit("Workspace access precheck failed: "), F.col("_error")))
        .when(missing, NOT_FOUND_MESSAGE)
        .when(accepted, F.concat(F.lit("Scanner SPN has accepted workspace role: "), role, F.lit(".")))
        .otherwise(
            F.concat(
                F.lit("Scanner SPN role '"),
                F.coalesce(blank_to_null(role), F.lit("UNKNOWN")),
                F.lit(f"' is not in {roles_text}."),
            )
        )
        .alias("permission_precheck_message"),
    )


def scoped_models(
    scope: DataFrame, inventory: DataFrame, precheck: DataFrame, workspaces: DataFrame | None, config: ScanConfig
) -> DataFrame:
    """Inventory rows of the scoped workspaces with their precheck result and workspace name."""
    models = landing.inventory(inventory)
    # Within a workspace a model counts once; of several names the greatest is kept.
    models = models.groupBy("workspace_id", "model_id").agg(
        F.max("model_name").alias("model_name"), F.max("is_default_model").alias("is_default_model")
    )
    detail = scope.join(precheck, "workspace_id")
    if workspaces is not None:
        names = landing.workspaces(workspaces).groupBy("workspace_id").agg(F.min("workspace_name").alias("listed_name"))
        detail = detail.join(names, "workspace_id", "left")
    else:
        detail = detail.withColumn("listed_name", F.lit(None).cast("string"))
    detail = detail.withColumn(
        "workspace_name",
        F.coalesce(blank_to_null(F.col("access_workspace_name")), F.col("listed_name"), F.col("workspace_id")),
    )
    return models.join(detail, "workspace_id").withColumn(
        "scope_source", F.lit("MODEL" if config.scope_models else "WORKSPACE")
    )


def requested_models(spark: SparkSession, scoped: DataFrame, config: ScanConfig) -> DataFrame:
    """Only the requested models; missing, ambiguous and excluded requests are errors."""
    wanted = guid_table(spark, config.scope_models, "request_order", "model_id")
    found = scoped.join(wanted, "model_id")
    # One row per requested id, so the answer is as small as the request.
    problems = (
        wanted.join(found.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.max("model_name").alias("name")), "model_id", "left")
        .select(
            "model_id",
            "request_order",
            F.when(F.col("n").isNull(), "missing")
            .when(F.col("n") > 1, "ambiguous")
            .when(F.lower(strip("name")).isin(config.excluded_names), "excluded")
            .alias("problem"),
        )
        .filter(F.col("problem").isNotNull())
        .orderBy("request_order")
        .collect()
    )
    by_kind = {kind: [p.model_id for p in problems if p.problem == kind] for kind in ("excluded", "missing", "ambiguous")}
    if by_kind["excluded"]:
        raise ScopeError("Requested, but on the exclusion list: " + ", ".join(by_kind["excluded"]))
    if by_kind["missing"]:
        raise ScopeError(
            "Requested, but in none of the workspaces in scope: " + ", ".join(by_kind["missing"])
        )
    if by_kind["ambiguous"]:
        raise ScopeError("Requested, but in several workspaces in scope: " + ", ".join(by_kind["ambiguous"]))
    return found.drop("request_order")


def eligible_models(scoped: DataFrame, config: ScanConfig) -> DataFrame:
    """Without requested ids: each model once, from the first scoped workspace, unless excluded by name."""
    first = top_per_group(scoped, ["model_id"], [F.col("scope_order")], 1, "_nth").drop("_nth")
    return first.filter(~F.coalesce(F.lower(strip("model_name")), F.lit("")).isin(config.excluded_names))


def without_defaults(targets: DataFrame, config: ScanConfig) -> DataFrame:
    """Default models are dropped, but only where they could be opened at all."""
    if config.include_default_models:
        return targets
    can_open = F.col("permission_precheck_status").isin(list(OPEN_PRECHECK_STATUSES))
    return targets.filter(~can_open | ~F.col("is_default_model"))


def check_size(targets: DataFrame, limit: int | None) -> DataFrame:
    """Refuse an empty scope and one above the limit that the caller set; looks at no more than limit + 1 rows."""
    n = targets.limit((limit or 0) + 1).count()
    if limit is not None and n > limit:
        raise ScopeError(f"{n} or more models are in scope, but this run may take {limit}; name fewer or allow more.")
    if n == 0:
        raise ScopeError("The scope holds no model that can be scanned.")
    return targets


def find_targets(
    spark: SparkSession,
    config: ScanConfig,
    inventory: DataFrame,
    access: DataFrame | None = None,
    workspaces: DataFrame | None = None,
    access_errors: DataFrame | None = None,
) -> DataFrame:
    scope = scope_frame(spark, config)
    precheck = workspace_precheck(scope, access, config, access_errors)
    scoped = scoped_models(scope, inventory, precheck, workspaces, config)
    if config.scope_models:
        targets = requested_models(spark, scoped, config)
    else:
        targets = eligible_models(scoped, config)
    return without_defaults(targets, config).select(*TARGET_COLUMNS)


def resolve_targets(spark: SparkSession, config: ScanConfig, *landed: DataFrame | None) -> DataFrame:
    """Targets of a run; raises ScopeError when there are none or too many."""
    return check_size(find_targets(spark, config, *landed), config.max_models_per_run)
