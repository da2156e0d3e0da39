"""A scan of all models in scope as one lazy plan.

Each attribute is a DataFrame that is only computed when it is used, so a report query reads the
evidence and columns it needs and nothing else.
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift import schemas
from modelsift.config import ScanConfig
from modelsift.operators import evidence as E
from modelsift.operators import findings as N
from modelsift.operators import rollup as R
from modelsift.operators import runstate as S
from modelsift.operators.ranking import union_all
from modelsift.operators.targets import check_size, find_targets
from modelsift.session import written
from modelsift.sources import landing


@dataclass(frozen=True)
class Landed:
    """Landing tables of all collectors. Any object with these attributes will do."""

    inventory: DataFrame
    workspace_access: DataFrame | None
    workspaces: DataFrame | None
    capacity: DataFrame
    model_size: DataFrame
    rule_violations: DataFrame
    storage_columns: DataFrame
    storage_tables: DataFrame
    storage_partitions: DataFrame
    refresh_history: DataFrame
    object_usage: DataFrame
    fallback_reasons: DataFrame
    item_access: DataFrame
    stage_errors: DataFrame
    workspace_access_errors: DataFrame | None = None  # workspace_id, message; may be missing
    stage_outcomes: DataFrame | None = None  # model_id, stage, status, message; may be missing


class OfScan:
    """Landed evidence narrowed to one scan: frames with a scan_id keep the rows of that scan only."""

    def __init__(self, landed, scan_id: str):
        self.landed, self.scan_id = landed, scan_id

    def __getattr__(self, name: str):
        value = getattr(self.landed, name)
        if isinstance(value, DataFrame) and "scan_id" in value.columns:
            return value.filter(F.col("scan_id") == self.scan_id).drop("scan_id")
        return value


class Scan:
    def __init__(self, spark: SparkSession, landed: Landed, config: ScanConfig):
        self.spark = spark
        self.landed = OfScan(landed, config.scan_id)
        self.config = config
        self.pinned: set[str] = set()

    # ---- models ----

    @cached_property
    def targets(self) -> DataFrame:
        """Written once, so that safeguard, states and grants see the same models."""
        landed = self.landed
        found = find_targets(
            self.spark,
            self.config,
            landed.inventory,
            landed.workspace_access,
            landed.workspaces,
            getattr(landed, "workspace_access_errors", None),
        )
        return check_size(written(found, "targets"), self.config.max_models_per_run)

    @cached_property
    def states(self) -> DataFrame:
        """Written once: every stage joins its evidence to this table of one row per model."""
        partitions = landing.evidence(self.landed.storage_partitions, "storage_partitions", raw=False)
        states = S.model_states(
            self.targets,
            self.landed.stage_errors,
            E.storage_modes(partitions),
            self.landed.model_size,
            self.landed.capacity,
            self.config,
            getattr(self.landed, "stage_outcomes", None),
        )
        return written(states, "model-states")

    def _of_stage(self, kind: str, stage: str, raw: bool = True) -> DataFrame:
        """Evidence of the models whose stage succeeded, with workspace and model names."""
        rows = landing.evidence(getattr(self.landed, kind), kind, raw=raw)
        rows = rows.drop("workspace_id")
        models = self.states.filter(F.col(f"{stage}_status") == "SUCCEEDED")
        attributes = ["model_id", "workspace_id", "workspace_name", "model_name"]
        if stage == "vpa":
            attributes.append("model_size_bytes")
        return rows.join(models.select(*attributes), "model_id")

    # ---- typed evidence ----

    @cached_property
    def column_rows(self) -> DataFrame:
        return E.column_rows(self._of_stage("storage_columns", "vpa"), self.config)

    @cached_property
    def table_rows(self) -> DataFrame:
        return E.table_rows(self._of_stage("storage_tables", "vpa"), self.config)

    @cached_property
    def usage_rows(self) -> DataFrame:
        return E.usage_rows(self._of_stage("object_usage", "usage"), self.config)

    @cached_property
    def refresh_rows(self) -> DataFrame:
        return self.latest_refreshes(None)

    def latest_refreshes(self, k: int | None) -> DataFrame:
        return E.refresh_rows(self._of_stage("refresh_history", "refresh"), self.config, k)

    @cached_property
    def fallback_rows(self) -> DataFrame:
        return E.fallback_checks(self._of_stage("fallback_reasons", "direct_lake"), self.config)

    @cached_property
    def access_rows(self) -> DataFrame:
        return E.access_rows(self._of_stage("item_access", "access_snapshot"), self.config)

    # ---- findings ----

    @cached_property
    def rule_findings(self) -> DataFrame:
        return N.rule_findings(self._of_stage("rule_violations", "bpa"), self.config)

    @cached_property
    def storage_findings(self) -> DataFrame:
        return N.storage_findings(self.column_rows, self.config)

    def largest_storage_findings(self, k: int) -> DataFrame:
        """Those of the k largest candidates of each model."""
        return N.storage_findings(self.column_rows, self.config, k)

    @cached_property
    def unused_findings(self) -> DataFrame:
        return N.unused_findings(self.usage_rows, self.column_rows, self.config)

    @cached_property
    def fallback_findings(self) -> DataFrame:
        return N.fallback_findings(self.fallback_rows, self.config)

    @cached_property
    def findings(self) -> DataFrame:
        parts = [self.rule_findings, self.storage_findings, self.unused_findings, self.fallback_findings]
        return union_all(parts)

    # ---- model and run rows ----

    @cached_property
    def finding_counts(self) -> DataFrame:
        return R.row_counts(self.findings, "finding_count")

    @cached_property
    def model_rows(self) -> DataFrame:
        return S.model_rows(self.states, self.finding_counts)

    @cached_property
    def dim_rows(self) -> DataFrame:
        return S.dim_rows(self.states)

    @cached_property
    def run_row(self) -> DataFrame:
        return S.run_row(self.states, self.config)

    @cached_property
    def summary(self) -> DataFrame:
        return S.run_summary(self.model_rows, self.config)

    @cached_property
    def header(self) -> DataFrame:
        return S.run_header(self.states, self.config)

    # ---- current state ----

    @cached_property
    def curated_models(self) -> DataFrame:
        return R.curated_models(self.states)

    def _usable(self, rows: DataFrame) -> DataFrame:
        ids = self.curated_models.select("model_id")
        return rows.join(ids, "model_id", "left_semi")

    @cached_property
    def usable_findings(self) -> DataFrame:
        return self._usable(self.findings)

    @cached_property
    def finding_groups(self) -> DataFrame:
        """Written once: all rollups read this small aggregate instead of the findings."""
        return written(R.finding_groups(self.usable_findings), "finding-groups")

    @cached_property
    def opportunities(self) -> DataFrame:
        return R.opportunities(self.finding_groups, self.curated_models)

    @cached_property
    def recommendations(self) -> DataFrame:
        return R.recommendations(self.finding_groups, self.curated_models)

    @cached_property
    def opportunity_recommendation_links(self) -> DataFrame:
        return R.recommendation_links(self.finding_groups, self.config.scan_id)

    @cached_property
    def opportunity_finding_links(self) -> DataFrame:
        return R.finding_links(self.usable_findings, self.config.scan_id)

    @cached_property
    def curated_findings(self) -> DataFrame:
        return R.curated_findings(self.usable_findings)

    @cached_property
    def column_storage(self) -> DataFrame:
        return R.column_storage(self._usable(self.column_rows))

    @cached_property
    def overview(self) -> DataFrame:
        """Counts need neither positions nor the order of refreshes, so they skip both.

        Written once: it has one row per model and is what the report's filters start from.
        """
        refresh = R.row_counts(self._of_stage("refresh_history", "refresh", raw=False), "refresh_count")
        counts = [
            R.group_counts(self.finding_groups),
            refresh,
            R.row_counts(self._of_stage("object_usage", "usage", raw=False), "usage_count"),
            R.row_counts(self._of_stage("fallback_reasons", "direct_lake", raw=False), "direct_lake_count"),
            R.row_counts(self._of_stage("item_access", "access_snapshot", raw=False), "access_count"),
        ]
        return written(R.overview(self.curated_models, counts), "overview")

    def pin(self) -> "Scan":
        """Write the rows that several tables are made of, before any of those is planned.

        All tables of a run then describe the same evidence, and it is read once.
        """
        for name in ("column_rows", "usage_rows", "fallback_rows", "findings"):
            if name not in self.pinned:
                self.__dict__[name] = written(getattr(self, name), name.replace("_", "-"))
                self.pinned.add(name)
        return self

    # ---- by table name ----

    def technical(self) -> dict[str, DataFrame]:
        frames = {
            "scan_run": self.run_row,
            "model_scan": self.model_rows,
            "finding": self.findings,
            "vpa_column": E.with_raw_json(self.column_rows),
            "vpa_table": self.table_rows,
            "object_usage": self.usage_rows,
            "refresh": self.refresh_rows,
            "direct_lake": self.fallback_rows,
            "item_access_snapshot": self.access_rows,
            "dim_model": self.dim_rows,
        }
        return {n: conform(df, schemas.technical_schema(n)) for n, df in frames.items()}

    def curated(self) -> dict[str, DataFrame]:
        frames = {
            "overview": self.overview,
            "opportunities": self.opportunities,
            "recommendations": self.recommendations,
            "findings": self.curated_findings,
            "opportunity_recommendation_links": self.opportunity_recommendation_links,
            "opportunity_finding_links": self.opportunity_finding_links,
            "column_storage": self.column_storage,
        }
        return {n: conform(df, schemas.curated_schema(n)) for n, df in frames.items()}


def conform(df: DataFrame, schema) -> DataFrame:
    """Declared columns in declared order and type."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
