"""Landed evidence by scan: each collector's rows in a folder of their own, and an outcome per model and stage.

A run reads the folders of its own scan and nothing else, so evidence of an earlier scan can neither be read nor cost
a scan over it. An outcome is landed only after the evidence it speaks of has been written: a stage that was never
collected, or whose collection broke off, has none and is NOT_RUN.
"""

import hashlib
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.functions.text import error_text

SUCCEEDED, FAILED = "SUCCEEDED", "FAILED"
CONCURRENT_WRITES = 4
OUTCOMES = "stage_outcomes"
OUTCOME_COLUMNS = "model_id string, stage string, status string, message string"

# What a kind has when its scan landed no row of it.
_BOOKKEEPING = "workspace_id string, model_id string, source_ordinal bigint, detected_at timestamp"
EMPTY = {
    "capacity": "workspace_id string, capacity_id string, capacity_name string",
    "model_size": "model_id string, model_size_bytes bigint",
    "stage_errors": "model_id string, stage string, message string",
    "inventory": "workspace_id string, workspace_name string, id string, name string, is_default_model boolean",
    "workspaces": "workspace_id string, workspace_name string",
    OUTCOMES: OUTCOME_COLUMNS,
}
KINDS = (
    "inventory", "workspace_access", "workspaces", "capacity", "model_size", "rule_violations", "storage_columns",
    "storage_tables", "storage_partitions", "refresh_history", "object_usage", "fallback_reasons", "item_access",
    "stage_errors", OUTCOMES,
)


class LandedScan:
    """The evidence of one scan; kinds are read when they are asked for."""

    workspace_access_errors = None

    def __init__(self, store: "LandingStore", scan_id: str):
        self._store, self._scan_id = store, scan_id

    def __getattr__(self, kind: str) -> DataFrame:
        if kind not in KINDS:
            raise AttributeError(kind)
        return self._store.rows(kind, self._scan_id)


class LandingStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def folder(self, kind: str, scan_id: str) -> str:
        """Named by a hash, so a scan id may have any characters."""
        return f"{self.root}/{kind}/scan-{hashlib.sha256(scan_id.encode()).hexdigest()}"

    def land(self, kind: str, rows: DataFrame, scan_id: str) -> None:
        """Rows of one kind of evidence of a scan; landing it again replaces it."""
        rows.write.mode("overwrite").parquet(self.folder(kind, scan_id))

    def land_outcomes(self, outcomes: DataFrame, scan_id: str) -> None:
        """outcomes(model_id, stage, status, message) of further models or stages; of several for a stage a failure counts."""
        rows = outcomes.select("model_id", "stage", "status", F.col("message").cast("string").alias("message"))
        rows.write.mode("append").parquet(self.folder(OUTCOMES, scan_id))

    def collect(
        self, stage: str, models: DataFrame, collectors: dict[str, Callable[[], DataFrame]], scan_id: str
    ) -> str:
        """Land what the collectors of a stage return, then the stage's outcome for models(model_id).

        The outcome is FAILED, with the error's text, when one of them raises; what had been landed stays unread.
        """
        status, message = SUCCEEDED, F.lit(None).cast("string")
        try:
            for kind, collector in collectors.items():
                self.land(kind, collector(), scan_id)
        except Exception as exc:
            status, message = FAILED, error_text(F.lit(type(exc).__name__), F.lit(str(exc)))
        rows = models.select("model_id", F.lit(stage).alias("stage"), F.lit(status).alias("status"), message.alias("message"))
        self.land_outcomes(rows, scan_id)
        return status

    def rows(self, kind: str, scan_id: str) -> DataFrame:
        """Rows of a scan's folder; none when the kind was not landed."""
        try:
            return self.spark.read.parquet(self.folder(kind, scan_id))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], EMPTY.get(kind, _BOOKKEEPING))

    def landed(self, scan_id: str) -> LandedScan:
        return LandedScan(self, scan_id)


def land_all(store: LandingStore, landed, scan_id: str, kinds: Iterable[str] = KINDS) -> None:
    """Copy the frames of another landing into a scan's folders, some at a time."""
    land_scans(store, {scan_id: landed}, kinds)


def land_scans(store: LandingStore, scans: dict, kinds: Iterable[str] = KINDS) -> None:
    """land_all of several scans (scan id -> landing); no scan waits for the last write of another."""
    frames = [(kind, getattr(landed, kind, None), scan_id) for kind in kinds for scan_id, landed in scans.items()]
    with ThreadPoolExecutor(CONCURRENT_WRITES) as pool:
        list(pool.map(lambda frame: store.land(*frame), [f for f in frames if f[1] is not None]))
