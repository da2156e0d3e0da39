"""Entry points for the driver: the flagship query, every registered query, and the SQL to check them."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from modelsift import schemas  # noqa: E402
from modelsift.functions.messages import is_direct_lake  # noqa: E402
from modelsift.functions.text import upn_list  # noqa: E402
from modelsift.operators import checks, contracts, profile, rules, targets, triage  # noqa: E402
from modelsift.operators.evidence import storage_modes, with_raw_json  # noqa: E402
from modelsift.operators.findings import ORDER_COLUMNS  # noqa: E402
from modelsift.operators.merge import replaced, synced_grants, upserted_in_scan  # noqa: E402
from modelsift.operators.ranking import first_per_key, union_all  # noqa: E402
from modelsift.plans import reports  # noqa: E402
from modelsift.plans.measures import ScanState, measures  # noqa: E402
from modelsift.operators.runstate import running_row  # noqa: E402
from modelsift.plans.scan import Scan, conform  # noqa: E402
from modelsift.session import configure, shared_folder, written  # noqa: E402
from modelsift.sinks.current import CurrentState  # noqa: E402
from modelsift.sinks.profiles import ProfileStore  # noqa: E402
from modelsift.sinks.tables import Tables, TableSpec, history_spec  # noqa: E402
from modelsift.sources import landing, testdata  # noqa: E402
from modelsift.sources.store import KINDS, OUTCOMES, LandingStore, land_scans  # noqa: E402
from modelsift.sources.testdata import SampleTables, holding_scan, prior_scan, sample_scan  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

# Declared keys and references of the sample tables.
TABLE_KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}
TABLE_REFERENCES = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events", "user_id", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]


def _of_scan(pick: Callable[[Scan], DataFrame]) -> Query:
    return lambda spark, folder: pick(sample_scan(configure(spark), folder))


def _finding(pick: Callable[[Scan], DataFrame]) -> Query:
    """Finding rows as stored, without the columns that only order them."""
    return _of_scan(lambda scan: pick(scan).drop(*ORDER_COLUMNS))


def _stored(table: str, pick: Callable[[Scan], DataFrame]) -> Query:
    return _of_scan(lambda scan: pick(scan).select(schemas.technical_schema(table).names))


def _report(name: str) -> Query:
    return _of_scan(lambda scan: reports.REPORTS[name](ScanState(scan)))


# ---- targets, over the estate of nations, customers and suppliers --------------------------------


def _estate(spark: SparkSession, folder: str, **changes):
    tables = SampleTables(configure(spark), folder)
    workspaces = tuple(f"{testdata.GUID_PREFIX}{n:012d}" for n in range(25))
    config = testdata.scan_config(workspace_ids=workspaces, max_models_per_run=10**9, **changes)
    return tables, config


def _workspace_precheck(spark: SparkSession, folder: str) -> DataFrame:
    tables, config = _estate(spark, folder)
    return targets.workspace_precheck(targets.scope_frame(spark, config), tables.estate_access, config).drop(
        "scope_order"
    )


def _targets_resolved(spark: SparkSession, folder: str, **changes) -> DataFrame:
    tables, config = _estate(spark, folder, **changes)
    return targets.resolve_targets(
        spark, config, tables.estate_inventory, tables.estate_access, tables.estate_workspaces
    )


def _targets_requested(spark: SparkSession, folder: str) -> DataFrame:
    requested = " ; ".join(f"{testdata.GUID_PREFIX}{100000 + n:012d}".upper() for n in range(10, 50))
    return _targets_resolved(spark, folder, model_ids=requested)


# ---- model rows --------------------------------------------------------------------------------


def _storage_mode(spark: SparkSession, folder: str) -> DataFrame:
    partitions = SampleTables(configure(spark), folder).storage_partitions
    modes = storage_modes(landing.evidence(partitions, "storage_partitions", raw=False))
    return modes.withColumn("is_direct_lake", is_direct_lake(F.col("storage_mode")))


def _dim_model_latest(spark: SparkSession, folder: str) -> DataFrame:
    history = sample_scan(configure(spark), folder).dim_rows.unionByName(prior_scan(spark, folder).dim_rows)
    return first_per_key(history, ["model_id"], [F.desc("last_scanned_at"), F.desc("latest_scan_id")])


def _opportunity_navigation(spark: SparkSession, folder: str) -> DataFrame:
    return reports.opportunity_navigation(ScanState(holding_scan(configure(spark), folder, "object_usage")))


# ---- table updates -------------------------------------------------------------------------------


def _upsert_finding_history(spark: SparkSession, folder: str) -> DataFrame:
    """History holds the scan before and an earlier attempt of this one; this scan's rows replace the latter."""
    shown = [
        "finding_id", "scan_id", "model_id", "rule_name", "severity", "object_type", "scanner_version", "detected_at"
    ]
    scan = holding_scan(configure(spark), folder)
    # Read three times, so written once, as the table writer does; of it and of the history only what is shown.
    new = written(scan.rule_findings.select(shown), "new-findings")
    attempt = new.filter(F.col("rule_name").isin("Rule 1", "Rule 2")).withColumn("scanner_version", F.lit("1.9.0"))
    held = prior_scan(spark, folder).rule_findings.select(shown).unionByName(attempt)
    return upserted_in_scan(held, new, schemas.TECHNICAL_KEYS["finding"], scan.config.scan_id)


def _replace_current_state(spark: SparkSession, folder: str) -> DataFrame:
    scan = sample_scan(configure(spark), folder)
    processed = scan.curated_models.select(F.col("model_id").alias(schemas.SLICE_COLUMN))
    return replaced(
        prior_scan(spark, folder).column_storage, scan.column_storage, processed, schemas.SLICE_COLUMN
    ).select(
        "column_storage_record_id", "analysis_id", "semantic_model_id", "table_name", "column_name", "total_size_bytes"
    )


def _access_grants_sync(spark: SparkSession, folder: str) -> DataFrame:
    scan = sample_scan(configure(spark), folder, access_sync_mode="replace_scanner_managed")
    tables = scan.landed
    open_targets = scan.targets.filter(F.col("permission_precheck_status") == "PASSED")
    requests = tables.grant_requests.join(open_targets.select("model_id", "workspace_id"), "model_id").select(
        "workspace_id", "model_id", upn_list(F.col("viewers")).alias("viewers")
    )
    return synced_grants(tables.held_grants, requests, scan.config)


# ---- stored tables -------------------------------------------------------------------------------


def _landed_scans(spark: SparkSession, folder: str) -> tuple[Scan, Scan]:
    """The prior scan and this one over landed evidence; of this one some refresh histories were never collected."""
    configure(spark)
    store = LandingStore(spark, f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}")
    evidence = [k for k in KINDS if k not in ("stage_errors", OUTCOMES)]
    scans = []
    # What both scans' collectors found is computed once; each scan lands all of it.
    current = holding_scan(spark, folder, "refresh_history", "object_usage")
    both = (prior_scan(spark, folder), current)
    land_scans(store, {scan.config.scan_id: scan.landed.landed for scan in both}, evidence)
    for scan in both:
        tables, scan_id = scan.landed.landed, scan.config.scan_id
        outcomes = testdata.outcomes_of(tables.inventory, tables.stage_errors)
        if not scans:
            store.land_outcomes(outcomes, scan_id)
        else:
            missing = testdata.uncollected(tables.inventory)
            store.land_outcomes(outcomes.join(missing, ["model_id", "stage"], "left_anti"), scan_id)
        scans.append(Scan(spark, store.landed(scan_id), scan.config))
    return scans[0], scans[1]


def _own_schema(spark: SparkSession) -> str:
    """A schema in the shared folder, so that queries leave other tables alone."""
    name = f"modelsift_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{shared_folder(spark)}/{name}'")
    return name


def _landed_model_scan_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _landed_scans(spark, folder)[1].model_rows.select(schemas.technical_schema("model_scan").names)


def _published_column_storage(spark: SparkSession, folder: str) -> DataFrame:
    """Both scans published one after the other; models that the second one does not publish keep the first one's rows."""
    scans = _landed_scans(spark, folder)
    schema = _own_schema(spark)
    current = CurrentState(spark, {n: f"{schema}.{n}" for n in ("overview", "column_storage")}, f"{schema}.pointer")
    current.ensure()
    for scan in scans:
        every = scan.curated()
        frames = {n: every[n] for n in current.names}
        models = scan.curated_models.select(F.col("model_id").alias(schemas.SLICE_COLUMN))
        current.publish(frames, models, scan.config.scan_id)
    return current.snapshot()["column_storage"]


def _stored_run_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The run's row as stored while it runs and when it has ended, in a table that began with fewer columns."""
    scan = sample_scan(configure(spark), folder)
    tables = Tables(spark, _own_schema(spark))
    spec = history_spec("scan_run", tables.history_schema)
    older = [f for f in spec.schema.fields if f.name not in ("parameters_hash", "error_message")]
    tables.ensure(TableSpec(spec.name, StructType(older)), evolve=True)
    tables.ensure(spec, evolve=True)
    held = []
    for row in (running_row(scan.targets, scan.config), scan.run_row):
        tables.upsert(spec, schemas.TECHNICAL_KEYS["scan_run"], conform(row, spec.schema), scan.config.scan_id)
        held.append(written(tables.rows(spec), "stored-run"))
    return held[0].unionByName(held[1])


# ---- lake tables ---------------------------------------------------------------------------------


def _column_profile(spark: SparkSession, folder: str) -> DataFrame:
    tables = SampleTables(configure(spark), folder)
    return profile.column_profile({t: tables.whole(t) for t in testdata.SAMPLE_SCHEMAS}, "sample-model")


def _stored_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Every table loaded in two parts, profiled part by part, beside the exact profile of the whole table."""
    tables = SampleTables(configure(spark), folder)
    store = ProfileStore(spark, f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}")
    for name, keys in TABLE_KEYS.items():
        whole = tables.whole(name)
        late = F.pmod(F.xxhash64(*keys), F.lit(4)) == 0
        store.add(name, "first", whole.filter(~late))
        store.add(name, "second", whole.filter(late))
    key = ["table_name", "column_name", "data_type"]
    exact = _column_profile(spark, folder).select(*key, F.col("cardinality").alias("exact"))
    near = F.abs(F.col("cardinality") - F.col("exact")) <= 0.05 * F.col("exact")
    return store.profile("sample-model").join(exact, key, "left").select(*key, "row_count", "null_count", near.alias("cardinality_near"))


def _unused_objects(spark: SparkSession, folder: str) -> DataFrame:
    tables = SampleTables(configure(spark), folder)
    return testdata.unused_objects(tables.model_objects, tables.usage_log, testdata.CLOCK, days=14)


def _key_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    state = ScanState(holding_scan(configure(spark), folder, "object_usage"))
    # These have a row per piece of evidence, the others one per model or rollup.
    wide = ("findings", "column_storage")
    return union_all([checks.key_uniqueness(t, state[t], keys, t in wide) for t, keys in schemas.CURATED_KEYS.items()])


def _table_key_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    tables = SampleTables(configure(spark), folder)
    return union_all([checks.key_uniqueness(t, tables.table(t), keys) for t, keys in TABLE_KEYS.items()])


def _relationship_integrity(spark: SparkSession, folder: str) -> DataFrame:
    state = ScanState(holding_scan(configure(spark), folder))
    return union_all([checks.relationship_integrity(state, *r) for r in schemas.RELATIONSHIPS])


def _table_relationship_integrity(spark: SparkSession, folder: str) -> DataFrame:
    tables = SampleTables(configure(spark), folder)
    frames = {t: tables.table(t) for t in testdata.SAMPLE_SCHEMAS}
    return union_all([checks.relationship_integrity(frames, *r) for r in TABLE_REFERENCES])


def _schema_contract(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return union_all(
        [
            checks.schema_contract(
                name,
                spark.read.parquet(f"{folder}/{name}.parquet"),
                testdata.expected_schema(name),
            )
            for name in testdata.EXPECTED_COLUMNS
        ]
    )


def _contract_check(spark: SparkSession, folder: str) -> DataFrame:
    """All tables as they are stored against the latest version of their landed contract."""
    contract = written(testdata.sample_contract(configure(spark)), "landed-contract")
    return contracts.contract_check({t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLE_KEYS}, contract)


def _landed_rule_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """The starter rules and two more, all read from a landed rule table."""
    landed = written(rules.rule_table(configure(spark), rules.STARTER_RULES + testdata.LANDED_RULES), "landed-rules")
    return profile.rule_violations(_column_profile(spark, folder), landed)


def _error_triage(spark: SparkSession, folder: str) -> DataFrame:
    return triage.error_triage(SampleTables(configure(spark), folder).error_log)


SLICERS = {
    "overview": {"analysis_status": ["SUCCEEDED"]},
    "findings": {"severity": ["WARNING"]},
    "column_storage": {"data_type": ["DateTime"]},
}


def _training_data() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the training-data operators and their pipeline, where these are installed."""
    try:
        import corpus_pipeline
        from modelsift.llm import queries as llm
    except ImportError:
        return {}, {}
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**llm.QUERIES, "pipeline": corpus_pipeline.run}, {**llm.ORACLES, **sql}


def queries() -> dict[str, Query]:
    return {**library_queries(), **_training_data()[0]}


def library_queries() -> dict[str, Query]:
    """The queries of the library itself, without the training-data operators."""
    return {
        "workspace_precheck": _workspace_precheck,
        "targets_resolved": _targets_resolved,
        "targets_requested_models": _targets_requested,
        "bpa_findings": _finding(lambda s: s.rule_findings),
        "vpa_column_rows": _stored("vpa_column", lambda s: with_raw_json(s.column_rows)),
        "vpa_table_rows": _stored("vpa_table", lambda s: s.table_rows),
        "storage_findings_topk": _finding(lambda s: s.largest_storage_findings(30)),
        "storage_mode": _storage_mode,
        "unused_objects": _unused_objects,
        "usage_rows": _stored("object_usage", lambda s: s.usage_rows),
        "unused_findings": _finding(lambda s: s.unused_findings),
        "refresh_latest": _stored("refresh", lambda s: s.latest_refreshes(20)),
        "direct_lake_checks": _stored("direct_lake", lambda s: s.fallback_rows),
        "fallback_findings": _finding(lambda s: s.fallback_findings),
        "access_snapshot": _stored("item_access_snapshot", lambda s: s.access_rows),
        "model_scan_rows": _stored("model_scan", lambda s: s.model_rows),
        "dim_model_latest": _dim_model_latest,
        "run_rollup": _of_scan(lambda s: s.run_row),
        "run_summary_json": _of_scan(lambda s: s.summary),
        "opportunities": _of_scan(lambda s: s.opportunities),
        "recommendations": _of_scan(lambda s: s.recommendations),
        "opportunity_recommendation_links": _of_scan(lambda s: s.opportunity_recommendation_links),
        "opportunity_finding_links": _of_scan(lambda s: s.opportunity_finding_links),
        "curated_findings": _of_scan(lambda s: s.curated_findings),
        "column_storage": _of_scan(lambda s: s.column_storage),
        "overview": _of_scan(lambda s: s.overview),
        "measures": _of_scan(lambda s: measures(ScanState(s))),
        "measures_sliced": _of_scan(lambda s: measures(ScanState(s), SLICERS)),
        **{f"report_{name}": _report(name) for name in reports.REPORTS},
        "report_top_columns_displayed": _of_scan(lambda s: reports.displayed(reports.largest_columns(ScanState(s)))),
        "opportunity_navigation": _opportunity_navigation,
        "upsert_finding_history": _upsert_finding_history,
        "replace_current_state": _replace_current_state,
        "access_grants_sync": _access_grants_sync,
        "landed_model_scan_rows": _landed_model_scan_rows,
        "published_column_storage": _published_column_storage,
        "stored_run_rows": _stored_run_rows,
        "column_profile": _column_profile,
        "stored_profile": _stored_profile,
        "rule_evaluation": lambda spark, folder: profile.rule_violations(_column_profile(spark, folder)),
        "key_uniqueness": _key_uniqueness,
        "table_key_uniqueness": _table_key_uniqueness,
        "relationship_integrity": _relationship_integrity,
        "table_relationship_integrity": _table_relationship_integrity,
        "schema_contract": _schema_contract,
        "contract_check": _contract_check,
        "landed_rule_evaluation": _landed_rule_evaluation,
        "error_triage": _error_triage,
    }


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the prioritized opportunities of all models."""
    return queries()["report_opportunities_table"](spark, "/root/testdata/sf0.001")


def library_oracles() -> dict[str, str]:
    """DuckDB SQL with the expected result of each query of the library itself."""
    from oracles.sql import ORACLES

    return dict(ORACLES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the expected result of each query that SQL can express."""
    return {**library_oracles(), **_training_data()[1]}
