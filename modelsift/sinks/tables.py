"""Parquet history tables with upsert by partition swap; the current state is in sinks.current.

A write never touches files in use: the new content of the partitions concerned goes to a fresh
folder, and the partitions are then pointed at it in the catalog. A write that fails before that
leaves the table as it was. History tables are partitioned by scan, so an upsert reads and rewrites
nothing but the rows of its own scan; other tables by a hash bucket of the model.
"""

import re
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelsift import schemas
from modelsift.operators.merge import upserted
from modelsift.session import written
from modelsift.sinks.current import CurrentState

BUCKETS = 64
BUCKET = "model_bucket"
FOLDER = "_folder"  # hash of a partition value: folder names never depend on the value's characters
SCHEMA_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def history_name(logical: str, schema: str = schemas.HISTORY_SCHEMA) -> str:
    name = schemas.HISTORY_PREFIX + logical
    return f"{schema}.{name}" if schema else name


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    bucketed_by: str | None = None  # None: partitioned by scan_id

    @property
    def partition(self) -> str:
        return BUCKET if self.bucketed_by else "scan_id"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.bucketed_by), F.lit(BUCKETS)).cast("int").alias(BUCKET)

    def placed(self, df: DataFrame) -> DataFrame:
        """Declared columns plus the partition column."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        return df.select(*columns, *([self.bucket()] if self.bucketed_by else []))


# Tables of few rows per scan; their keys live across scans, so they are bucketed.
HISTORY_BUCKETS = {"dim_model": "model_id", "model_access": "model_id"}


def history_spec(logical: str, schema: str = schemas.HISTORY_SCHEMA) -> TableSpec:
    return TableSpec(
        history_name(logical, schema), schemas.technical_schema(logical), HISTORY_BUCKETS.get(logical)
    )


@dataclass(frozen=True)
class PendingSwap:
    """New partition folders of a table, written but not yet visible."""

    spec: TableSpec
    folder: str
    filled: dict  # partition value -> name of its folder
    emptied: list


def quoted(text: str) -> str:
    """SQL literal of any text."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


class Tables:
    def __init__(self, spark: SparkSession, history_schema: str = schemas.HISTORY_SCHEMA):
        self.spark = spark
        self.history_schema = history_schema
        self.current = CurrentState(spark)

    # ---- creation and evolution ----

    def ensure_schema(self, name: str) -> None:
        if not SCHEMA_NAME.fullmatch(name):
            raise ValueError(f"Schema name contains invalid characters: {name}")
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")

    def ensure_all(self) -> None:
        if self.history_schema:
            self.ensure_schema(self.history_schema)
        for name in schemas.BUSINESS_SCHEMAS:
            self.ensure_schema(name)
        for logical in schemas.TECHNICAL_TABLES:
            self.ensure(history_spec(logical, self.history_schema), evolve=True)
        self.current.ensure()

    def ensure(self, spec: TableSpec, evolve: bool) -> None:
        """Create the table, or add declared columns it lacks; nothing is ever dropped or retyped."""
        if not self.spark.catalog.tableExists(spec.name):
            columns = [(f.name, f.dataType.simpleString()) for f in spec.schema.fields]
            if spec.bucketed_by:
                columns.append((BUCKET, "int"))
            ddl = ", ".join(f"`{n}` {t}" for n, t in columns)
            self.spark.sql(f"CREATE TABLE {spec.name} ({ddl}) USING parquet PARTITIONED BY (`{spec.partition}`)")
        elif evolve:
            existing = {c.lower() for c in self.spark.table(spec.name).columns}
            added = [f for f in spec.schema.fields if f.name.lower() not in existing]
            if added:
                ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
                self.spark.sql(f"ALTER TABLE {spec.name} ADD COLUMNS ({ddl})")

    # ---- reading ----

    def rows(self, spec: TableSpec) -> DataFrame:
        return self.spark.table(spec.name).select(spec.schema.names)

    def _partitions(self, spec: TableSpec) -> set[str]:
        shown = self.spark.sql(f"SHOW PARTITIONS {spec.name}").collect()
        return {unquote(r[0].split("=", 1)[1]) for r in shown}

    def held(self, spec: TableSpec, values: list) -> list:
        """Those of the partition values the table has."""
        existing = self._partitions(spec)
        return [v for v in values if str(v) in existing]

    def rows_of(self, spec: TableSpec, values: list) -> DataFrame:
        """Current rows of some partitions; the filter prunes the scan to them."""
        return self.spark.table(spec.name).filter(F.col(spec.partition).isin(values))

    # ---- writing ----

    def upsert(self, spec: TableSpec, keys: list[str], rows: DataFrame, scan_id: str | None = None) -> None:
        """Rows replace those with their key, others stay; without rows nothing changes.

        scan_id tells that all rows are of that scan, so its first write needs no look at the table.
        """
        new = spec.placed(rows.select(spec.schema.names))
        existing = self._partitions(spec)
        first_write = not spec.bucketed_by and scan_id is not None and scan_id not in existing
        if existing and not first_write:
            # Read three times below, so it is computed once.
            new = written(new, "upsert")
            touched = [r[0] for r in new.select(spec.partition).distinct().collect()]
            held = [v for v in touched if str(v) in existing]
            if held:
                new = upserted(self.rows_of(spec, held).select(new.columns), new, keys)
        self.commit([self._stage(spec, new, [])])

    def rewrite(self, spec: TableSpec, rows: DataFrame, held: list) -> None:
        """rows are the whole new content of the held partitions."""
        self.commit([self._stage(spec, spec.placed(rows), held)])

    def _location(self, spec: TableSpec) -> str:
        described = self.spark.sql(f"DESCRIBE EXTENDED {spec.name}")
        return described.filter("col_name = 'Location'").first()["data_type"].rstrip("/")

    def _stage(self, spec: TableSpec, rows: DataFrame, may_empty: list) -> PendingSwap:
        folder = f"{self._location(spec)}/batch-{uuid.uuid4().hex}"
        if spec.bucketed_by:
            # Rows of a bucket come together, else every task writes a file per bucket. Rebalancing
            # splits a bucket that holds much of the data over several tasks.
            rows = rows.hint("rebalance", spec.partition)
        rows = rows.withColumn(FOLDER, F.sha2(F.col(spec.partition).cast("string"), 256))
        # The files keep the partition's value, too; the table takes it from the catalog.
        rows.write.partitionBy(FOLDER).parquet(folder)
        stored = self.spark.read.schema(rows.schema).parquet(folder)
        # One value per partition: buckets are few, history writes concern one scan.
        filled = dict(tuple(r) for r in stored.select(spec.partition, FOLDER).distinct().collect())
        if any(v is None or v == "" for v in filled):
            raise ValueError(f"Rows of {spec.name} without a {spec.partition} cannot be stored.")
        return PendingSwap(spec, folder, filled, [v for v in may_empty if v not in filled])

    def commit(self, swaps: list[PendingSwap]) -> None:
        """Point the partitions at their new folders: catalog changes only."""
        for swap in swaps:
            spec = swap.spec
            existing = self._partitions(spec)
            for value, name in swap.filled.items():
                part, folder = self._clause(spec, value), quoted(f"{swap.folder}/{FOLDER}={name}")
                if str(value) in existing:
                    self.spark.sql(f"ALTER TABLE {spec.name} {part} SET LOCATION {folder}")
                else:
                    self.spark.sql(f"ALTER TABLE {spec.name} ADD IF NOT EXISTS {part} LOCATION {folder}")
            for value in swap.emptied:
                self.spark.sql(f"ALTER TABLE {spec.name} DROP IF EXISTS {self._clause(spec, value)}")
            self.spark.catalog.refreshTable(spec.name)

    def _clause(self, spec: TableSpec, value) -> str:
        shown = str(value) if spec.bucketed_by else quoted(value)
        return f"PARTITION (`{spec.partition}` = {shown})"
