"""The report's fifteen queries. Each takes the curated tables and optional slicers."""

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsift.functions.text import blank_to_null
from modelsift.functions.values import megabytes
from modelsift.plans.measures import GROUP_COLUMNS, SlicedState, Slicers, _combined, _count, finding_measures

# Columns shown by each table visual and slicer.
TABLES = {
    "analysis_coverage": (
        "overview",
        [
            "workspace_name",
            "semantic_model_name",
            "analysis_status",
            "refresh_history_status",
            "object_usage_analysis_status",
            "direct_lake_analysis_status",
            "data_availability_explanation",
        ],
    ),
    "severity_slicer": ("opportunities", ["highest_severity"]),
    "domain_slicer": ("opportunities", ["optimization_domain"]),
    "recommendations_table": (
        "recommendations",
        [
            "semantic_model_name",
            "recommendation_title",
            "recommended_action",
            "change_risk",
            "affected_finding_count",
        ],
    ),
    "risk_slicer": ("recommendations", ["change_risk"]),
    "finding_severity_slicer": ("findings", ["severity"]),
    "findings_table": (
        "findings",
        ["semantic_model_name", "severity", "rule_name", "affected_object_name", "finding_description"],
    ),
    "storage_model_slicer": ("column_storage", ["semantic_model_name"]),
    "storage_table": (
        "column_storage",
        [
            "semantic_model_name",
            "table_name",
            "column_name",
            "data_type",
            "cardinality",
            "total_size_bytes",
            "percentage_of_semantic_model_size",
        ],
    ),
}
OPPORTUNITY_COLUMNS = [
    "semantic_model_name",
    "opportunity_title",
    "highest_severity",
    "optimization_domain",
    "finding_count",
    "recommendation_count",
    "opportunity_summary",
]
# Charts as (table, category).
COUNT_CHARTS = {
    "findings_by_severity": ("findings", "severity", "total_findings"),
    "recommendations_by_domain": ("recommendations", "optimization_domain", "total_recommendations"),
    "findings_by_rule": ("findings", "rule_name", "total_findings"),
}


def optimization_kpis(state: Mapping, slicers: Slicers | None = None) -> DataFrame:
    sliced = SlicedState(state, slicers)
    return _combined(
        [
            sliced["overview"].agg(F.count_distinct("semantic_model_id").alias("models_scanned")),
            sliced["opportunities"].agg(_count("total_opportunities")),
            *finding_measures(sliced),
        ]
    )


def opportunities_table(state: Mapping, slicers: Slicers | None = None) -> DataFrame:
    """Most urgent first."""
    return (
        SlicedState(state, slicers)["opportunities"]
        .select(*OPPORTUNITY_COLUMNS, "priority_score")
        .distinct()
        .orderBy(F.desc("priority_score"), "semantic_model_name", "opportunity_title")
        .select(*OPPORTUNITY_COLUMNS)
    )


def largest_columns(state: Mapping, slicers: Slicers | None = None) -> DataFrame:
    """Storage by column name, across tables and models."""
    return (
        SlicedState(state, slicers)["column_storage"]
        .groupBy("column_name")
        .agg(megabytes(F.sum("total_size_bytes")).alias("total_column_storage_mb"))
    )


def table_visual(name: str):
    table, columns = TABLES[name]

    def query(state: Mapping, slicers: Slicers | None = None) -> DataFrame:
        sliced = SlicedState(state, slicers)
        if table == "findings" and set(columns) <= set(GROUP_COLUMNS) and sliced.finding_groups is not None:
            return sliced.finding_groups.select(*columns).distinct()
        return sliced[table].select(*columns).distinct()

    return query


def count_chart(name: str):
    table, category, measure = COUNT_CHARTS[name]

    def query(state: Mapping, slicers: Slicers | None = None) -> DataFrame:
        sliced = SlicedState(state, slicers)
        if table == "findings" and category in GROUP_COLUMNS and sliced.finding_groups is not None:
            return sliced.finding_groups.groupBy(category).agg(F.sum("n").alias(measure))
        return sliced[table].groupBy(category).agg(F.count(F.lit(1)).alias(measure))

    return query


REPORTS = {
    "optimization_kpis": optimization_kpis,
    "opportunities_table": opportunities_table,
    "top_columns": largest_columns,
    **{name: table_visual(name) for name in TABLES},
    **{name: count_chart(name) for name in COUNT_CHARTS},
}


def displayed(df: DataFrame) -> DataFrame:
    """Numbers as the report shows them: thousands separators, two decimals for fractions."""
    formats = {"int": 0, "bigint": 0, "double": 2}
    return df.select(
        *[
            F.format_number(name, formats[kind]).alias(name) if kind in formats else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def opportunity_navigation(state: Mapping) -> DataFrame:
    """From each opportunity to its recommendations and findings, through the link tables.

    Links and findings are first brought to one row per pair and id, so repeated finding ids neither
    multiply nor pile up in one task; link_count tells how many links a pair stands for.
    """
    opportunities = state["opportunities"].select(
        "opportunity_id", "semantic_model_name", "opportunity_title", "highest_severity"
    )

    def reached(links: str, entities: str, key: str, title: str, kind: str) -> DataFrame:
        pairs = state[links].groupBy("opportunity_id", "related_entity_id").agg(
            F.count(F.lit(1)).alias("link_count")
        )
        # Ids are hashes that contain the title, so distinct pairs are one row per id.
        titles = (
            state[entities]
            .select(F.col(key).alias("related_entity_id"), blank_to_null(F.col(title)).alias("related_title"))
            .distinct()
        )
        return pairs.join(titles, "related_entity_id").withColumn("related_kind", F.lit(kind))

    via_recommendations = reached(
        "opportunity_recommendation_links",
        "recommendations",
        "recommendation_id",
        "recommendation_title",
        "recommendation",
    )
    via_findings = getattr(state, "finding_paths", None)
    if via_findings is None:
        via_findings = reached("opportunity_finding_links", "findings", "finding_id", "rule_name", "finding")
    else:
        via_findings = via_findings.select(
            F.col("finding_id").alias("related_entity_id"),
            "opportunity_id",
            "link_count",
            blank_to_null(F.col("rule_name")).alias("related_title"),
            F.lit("finding").alias("related_kind"),
        )
    return via_recommendations.unionByName(via_findings).join(opportunities, "opportunity_id").select(
        "opportunity_id",
        "semantic_model_name",
        "opportunity_title",
        "highest_severity",
        "related_kind",
        "related_entity_id",
        "related_title",
        "link_count",
    )
