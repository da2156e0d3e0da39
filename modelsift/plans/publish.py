"""One run end to end: history, current state, grants and the run row."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsift import schemas
from modelsift.config import ScanConfig
from modelsift.operators import runstate as S
from modelsift.operators.merge import grant_rows, viewer_requests, without_withdrawn
from modelsift.plans.scan import Scan, conform
from modelsift.sinks.tables import Tables, history_spec


CONCURRENT_WRITES = 4


class RunFailed(RuntimeError):
    """The run's final status asks the caller to stop."""


def _run_row(tables: Tables, row: DataFrame) -> None:
    spec = history_spec("scan_run", tables.history_schema)
    tables.upsert(spec, schemas.TECHNICAL_KEYS["scan_run"], conform(row, spec.schema))


def sync_grants(tables: Tables, requests: DataFrame, config: ScanConfig) -> None:
    """Apply the requested grants to the stored access table."""
    if config.access_sync_mode == "none":
        return
    spec = history_spec("model_access", tables.history_schema)
    grants = grant_rows(requests, config)
    if config.access_sync_mode == "replace_scanner_managed":
        buckets = [r[0] for r in requests.select(spec.bucket()).distinct().collect()]
        held = tables.held(spec, buckets)
        if held:
            current = tables.rows_of(spec, held).select(spec.schema.names)
            tables.rewrite(spec, without_withdrawn(current, requests, grants, config), held)
    tables.upsert(spec, schemas.TECHNICAL_KEYS["model_access"], grants)


def _at_once(write, items: list) -> list:
    """Writes of different tables side by side, so that small ones do not wait for large ones."""
    with ThreadPoolExecutor(CONCURRENT_WRITES) as pool:
        return list(pool.map(write, items))


def publish_history(tables: Tables, scan: Scan) -> None:
    """Upsert the technical rows of a scan, one write per table."""

    def upsert(item: tuple[str, DataFrame]) -> None:
        logical, rows = item
        spec = history_spec(logical, tables.history_schema)
        tables.upsert(spec, schemas.TECHNICAL_KEYS[logical], rows, scan.config.scan_id)

    _at_once(upsert, [i for i in scan.technical().items() if i[0] != "scan_run"])


def publish_current_state(tables: Tables, scan: Scan) -> None:
    """Replace the slices of the usable analyses; failed and skipped models keep theirs.

    All tables are written before the pointer to them is switched.
    """
    processed = scan.curated_models.select(F.col("model_id").alias(schemas.SLICE_COLUMN))
    tables.current.publish(scan.curated(), processed, scan.config.scan_id)


def run(tables: Tables, scan: Scan, initialize_only: bool = False, requests: DataFrame | None = None) -> str | None:
    """Run a scan and return its counts as a JSON document; raises RunFailed when the configuration says so.

    The entries per model are the scan's rows in model_scan, so the driver gets the same few numbers for any run.
    """
    config = scan.config
    tables.ensure_all()
    if initialize_only:
        return None
    try:
        _run_row(tables, S.running_row(scan.targets, config))
        asked = viewer_requests(scan.targets, config) if requests is None else requests
        sync_grants(tables, asked, config)
        scan.pin()
        publish_history(tables, scan)
        publish_current_state(tables, scan)
    except Exception as exc:
        # The run is recorded as failed, with as many targets as had been found.
        known = scan.targets if "targets" in vars(scan) else tables.spark.range(0)
        failed = S.finish_run(S.unscanned(known), config, error=(type(exc).__name__, str(exc)))
        _run_row(tables, failed)
        raise
    _run_row(tables, scan.run_row)
    summary = scan.header.first()["summary_json"]
    final = scan.run_row.select("status", "failed_count", "skipped_count").first()
    if (final.failed_count and config.fail_on_failed_model) or (final.skipped_count and config.fail_on_skipped_model):
        raise RunFailed(summary)
    return summary


def stored_table(tables: Tables, logical: str) -> DataFrame:
    """Rows of a stored table by logical name."""
    if logical in schemas.CURATED_NAMES:
        return tables.current.snapshot()[logical]
    return tables.rows(history_spec(logical, tables.history_schema))
