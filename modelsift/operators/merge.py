"""Upsert, slice replacement and grant synchronization as joins.

These return the rows a table should hold; sinks.tables decides which partitions to rewrite.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsift.config import OPEN_PRECHECK_STATUSES, ScanConfig
from modelsift.functions.text import stable_id

EXPLICIT_SOURCE = "SCAN_REQUEST_EXPLICIT"


def upserted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows without a source row of their key, and all source rows, also several of one key."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def upserted_in_scan(target: DataFrame, source: DataFrame, keys: list[str], scan_id: str) -> DataFrame:
    """upserted for history whose keys never leave their scan: rows of other scans stay, without a join.

    Keys of findings are made with the scan's id, so no row of another scan has a key of the source.
    """
    own = F.col("scan_id").eqNullSafe(F.lit(scan_id))
    return target.filter(~own).unionByName(upserted(target.filter(own), source, keys))


def replaced(target: DataFrame, source: DataFrame, processed: DataFrame, column: str) -> DataFrame:
    """Slices of the processed ids are replaced, also by nothing; all other rows stay."""
    return target.join(processed.select(column), column, "left_anti").unionByName(source)


def viewer_requests(targets: DataFrame, config: ScanConfig) -> DataFrame:
    """Every viewer of the run's parameter for every target that could be opened."""
    viewers = F.array(*[F.lit(v) for v in config.viewer_upns]).cast("array<string>")
    return targets.filter(F.col("permission_precheck_status").isin(list(OPEN_PRECHECK_STATUSES))).select(
        "workspace_id", "model_id", viewers.alias("viewers")
    )


def grant_rows(requests: DataFrame, config: ScanConfig) -> DataFrame:
    """One active grant per model and requested viewer. requests: workspace_id, model_id, viewers."""
    now = F.lit(config.completed_at).cast("timestamp")
    wanted = requests.select("workspace_id", "model_id", F.explode("viewers").alias("principal_upn"))
    return wanted.groupBy("model_id", "principal_upn").agg(F.min("workspace_id").alias("workspace_id")).select(
        stable_id(F.col("model_id"), F.col("principal_upn"), EXPLICIT_SOURCE).alias("access_key"),
        "workspace_id",
        "model_id",
        "principal_upn",
        F.lit(EXPLICIT_SOURCE).alias("source"),
        F.lit(True).alias("is_active"),
        now.alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        F.lit(config.requester).cast("string").alias("updated_by"),
        now.alias("updated_at"),
    )


def without_withdrawn(access: DataFrame, requests: DataFrame, grants: DataFrame, config: ScanConfig) -> DataFrame:
    """End the active explicit grants of the requested models that are no longer asked for.

    Requests are for targets of the run, so their models are as few as the safeguard allows.
    """
    wanted = grants.select("model_id", "principal_upn", F.lit(True).alias("_wanted"))
    models = requests.groupBy("model_id").agg(F.max(F.size("viewers") > 0).alias("_any"))
    joined = access.join(wanted, ["model_id", "principal_upn"], "left").join(
        models, "model_id", "left"
    )
    # A grant without a principal is only ended when nobody is asked for.
    absent = ~F.col("_any") | (F.col("principal_upn").isNotNull() & F.col("_wanted").isNull())
    ends = F.coalesce(
        F.col("_any").isNotNull() & (F.col("source") == EXPLICIT_SOURCE) & F.col("is_active") & absent, F.lit(False)
    )
    now = F.lit(config.completed_at).cast("timestamp")
    changed = {"is_active": F.lit(False), "valid_to": now, "updated_at": now}
    return joined.select(
        *[
            F.when(ends, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in access.columns
        ]
    )


def synced_grants(access: DataFrame, requests: DataFrame, config: ScanConfig) -> DataFrame:
    """The access table after a run, by the configured mode."""
    if config.access_sync_mode == "none":
        return access
    grants = grant_rows(requests, config)
    if config.access_sync_mode == "replace_scanner_managed":
        access = without_withdrawn(access, requests, grants, config)
    return upserted(access, grants, ["access_key"])
