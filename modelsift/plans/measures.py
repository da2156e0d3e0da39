"""The current state under slicers, and the ten measures over it."""

from collections.abc import Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift import schemas
from modelsift.functions.values import is_high_severity, megabytes
from modelsift.operators.rollup import linked_findings
from modelsift.plans.scan import Scan
from modelsift.sinks.current import CurrentState

# Columns of findings that the finding groups have, too: slicers and charts on these need no findings.
GROUP_COLUMNS = (
    schemas.SLICE_COLUMN, "finding_source", "optimization_domain", "rule_name", "recommended_action", "severity", "change_risk",
)

# Slicers: table -> column -> accepted values.
Slicers = dict[str, dict[str, list]]


class ScanState(Mapping):
    """Curated tables as the plans of a scan; nothing runs until a table is used."""

    ATTRIBUTES = {
        "overview": "overview",
        "opportunities": "opportunities",
        "recommendations": "recommendations",
        "findings": "curated_findings",
        "opportunity_recommendation_links": "opportunity_recommendation_links",
        "opportunity_finding_links": "opportunity_finding_links",
        "column_storage": "column_storage",
    }

    def __init__(self, scan: Scan):
        self.scan = scan

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self.scan, self.ATTRIBUTES[name])

    @property
    def finding_groups(self) -> DataFrame | None:
        """The small aggregate of the findings, where there is one."""
        return self.scan.finding_groups

    @property
    def finding_paths(self) -> DataFrame | None:
        """One row per opportunity and finding, where findings know their opportunity; else through the links."""
        return linked_findings(self.scan.usable_findings)

    def __iter__(self) -> Iterator[str]:
        return iter(self.ATTRIBUTES)

    def __len__(self) -> int:
        return len(self.ATTRIBUTES)


class StoredState(ScanState):
    """Curated tables as published, all at the state that is current when this is made (or at another snapshot)."""

    finding_groups = None
    finding_paths = None

    def __init__(self, spark: SparkSession, snapshot: Mapping | None = None):
        self.snapshot = CurrentState(spark).snapshot() if snapshot is None else snapshot

    def __getitem__(self, name: str) -> DataFrame:
        return self.snapshot[name]


class SlicedState(ScanState):
    """A state under slicers. A filter on a table also restricts the tables related to it as children."""

    def __init__(self, state: Mapping, slicers: Slicers | None):
        self.state = state
        self.slicers = slicers or {}

    def __getitem__(self, name: str) -> DataFrame:
        df = self.state[name]
        for column, accepted in self.slicers.get(name, {}).items():
            df = df.filter(F.col(column).isin(accepted))
        for child, child_column, parent, parent_column in schemas.RELATIONSHIPS:
            if child == name and self._restricted(parent):
                keys = self[parent].select(F.col(parent_column).alias(child_column))
                df = df.join(keys, child_column, "left_semi")
        return df

    @property
    def finding_groups(self) -> DataFrame | None:
        """The finding groups under the slicers, where all of those on findings are columns of the groups."""
        groups, own = getattr(self.state, "finding_groups", None), self.slicers.get("findings", {})
        if groups is None or not set(own) <= set(GROUP_COLUMNS):
            return None
        for column, accepted in own.items():
            groups = groups.filter(F.col(column).isin(accepted))
        for child, child_column, parent, parent_column in schemas.RELATIONSHIPS:
            if child == "findings" and self._restricted(parent):
                keys = self[parent].select(F.col(parent_column).alias(child_column))
                groups = groups.join(keys, child_column, "left_semi")
        return groups

    def _restricted(self, name: str) -> bool:
        if self.slicers.get(name):
            return True
        return any(child == name and self._restricted(parent) for child, _, parent, _ in schemas.RELATIONSHIPS)

    def without(self, table: str, column: str) -> "SlicedState":
        """The same slicers but for one column's."""
        slicers = {t: {k: v for k, v in c.items() if (t, k) != (table, column)} for t, c in self.slicers.items()}
        return SlicedState(self.state, slicers)


def _combined(parts: list[DataFrame]) -> DataFrame:
    """One-row frames side by side, by way of a union; no join."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.agg(*[F.max(c).alias(c) for c in union.columns])


def _count(name: str, condition: Column | None = None) -> Column:
    return (F.count(F.lit(1)) if condition is None else F.count_if(condition)).alias(name)


def finding_measures(state: SlicedState, savings: bool = False) -> list[DataFrame]:
    """Total and high findings, and on request the savings, in one pass; over the finding groups if these will do.

    The high count replaces a severity slicer instead of narrowing it, which takes a second pass.
    """
    replaces = "severity" in state.slicers.get("findings", {})
    high = is_high_severity(F.col("severity"))
    groups = state.finding_groups
    saved = "known_saving" if groups is not None else "estimated_saving_bytes"
    more = [
        megabytes(F.sum(f"{saved}_{bound}")).alias(f"estimated_saving_mb_{bound}")
        for bound in (("low", "high") if savings else ())
    ]
    # Without the slicer on severity; the measure's own condition takes its place.
    replaced = state.without("findings", "severity") if replaces else None
    if groups is not None:
        summed = lambda of, name: F.coalesce(F.sum(of), F.lit(0)).alias(name)
        total = summed("n", "total_findings")
        if not replaces:
            return [groups.agg(total, summed(F.when(high, F.col("n")), "high_findings"), *more)]
        return [groups.agg(total, *more), replaced.finding_groups.agg(summed(F.when(high, F.col("n")), "high_findings"))]
    if not replaces:
        return [state["findings"].agg(_count("total_findings"), _count("high_findings", high), *more)]
    return [
        state["findings"].agg(_count("total_findings"), *more),
        replaced["findings"].agg(_count("high_findings", high)),
    ]


def measures(state: Mapping, slicers: Slicers | None = None) -> DataFrame:
    sliced = SlicedState(state, slicers)
    return _combined(
        [
            sliced["overview"].agg(
                F.count_distinct("semantic_model_id").alias("models_scanned"),
                F.max("analysis_completed_at").alias("latest_analysis_at"),
            ),
            sliced["opportunities"].agg(_count("total_opportunities")),
            sliced["recommendations"].agg(_count("total_recommendations")),
            sliced["column_storage"].agg(
                _count("columns_analyzed"), megabytes(F.sum("total_size_bytes")).alias("total_column_storage_mb")
            ),
            *finding_measures(sliced, savings=True),
        ]
    )
