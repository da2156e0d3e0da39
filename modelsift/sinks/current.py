"""The current state per model: rows by publication, and one small pointer table that is switched last.

A publication adds one partition to each curated table and rewrites nothing. Readers see a row only if the pointer
table names its publication for its model. The pointer's next content (one row per model) is written to a fresh
folder when every table is written, and a single catalog change then points at it: all tables change together, and
a run that fails before that has changed nothing. Two runs at once cannot undo each other's models: a pointer that
was made from another content than the one in force is made again. The check and the switch are two catalog
calls, so runs that switch within the same instant need a catalog that serialises them.

Partitions that no pointer names any more stay readable by their snapshot until retire() drops them.
"""

import uuid
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelsift import schemas

PUBLICATION = "publication"
POINTER = T.StructType([T.StructField(c, T.StringType()) for c in (schemas.SLICE_COLUMN, PUBLICATION, "analysis_id")])
ROWS = "_rows"
CONCURRENT_WRITES = 4
ATTEMPTS = 20


class Snapshot(Mapping):
    """Every curated table at one pointer, whatever is published meanwhile."""

    finding_groups = None

    def __init__(self, current: "CurrentState", folder: str):
        self.current = current
        self.folder = folder

    @property
    def pointers(self) -> DataFrame:
        return self.current.spark.read.schema(POINTER).parquet(self.folder)

    def __getitem__(self, name: str) -> DataFrame:
        # The comparison holds for every publication; with it Spark reads only the partitions that the pointers name.
        named = self.pointers.filter(F.col(PUBLICATION) > "").select(PUBLICATION, schemas.SLICE_COLUMN)
        rows = self.current.spark.table(self.current.names[name] + ROWS)
        kept = rows.join(named, [PUBLICATION, schemas.SLICE_COLUMN], "left_semi")
        return kept.select(self.current.columns(name))

    def __iter__(self) -> Iterator[str]:
        return iter(self.current.names)

    def __len__(self) -> int:
        return len(self.current.names)


class CurrentState:
    """names: logical table -> its view's name; pointer: the pointer table; declared: logical table -> columns."""

    def __init__(
        self,
        spark: SparkSession,
        names: dict[str, str] | None = None,
        pointer: str = schemas.POINTER_TABLE,
        declared: dict[str, T.StructType] | None = None,
    ):
        self.spark = spark
        self.names = names or schemas.CURATED_NAMES
        self.pointer = pointer
        self.declared = declared or {n: schemas.curated_schema(n) for n in self.names}

    def columns(self, name: str) -> list[str]:
        return self.declared[name].names

    def ensure(self) -> None:
        """Create what is absent: the pointer, the tables of rows, and a view of the current rows for each."""
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in POINTER.fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.pointer} ({fields}) USING parquet")
        for name, view in self.names.items():
            declared = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.declared[name].fields]
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {view}{ROWS} ({', '.join(declared)}, `{PUBLICATION}` string) "
                f"USING parquet PARTITIONED BY (`{PUBLICATION}`)"
            )
            if not self.spark.catalog.tableExists(view):
                self._make_view(name, view)

    def _make_view(self, name: str, view: str) -> None:
        shown = ", ".join(f"r.`{c}`" for c in self.columns(name))
        self.spark.sql(
            f"CREATE VIEW {view} AS SELECT {shown} FROM {view}{ROWS} r LEFT SEMI JOIN {self.pointer} p "
            f"ON r.`{PUBLICATION}` = p.`{PUBLICATION}` AND r.{schemas.SLICE_COLUMN} = p.{schemas.SLICE_COLUMN} "
            f"AND p.`{PUBLICATION}` > ''"
        )

    # ---- reading ----

    def location(self) -> str:
        described = self.spark.sql(f"DESCRIBE EXTENDED {self.pointer}")
        return described.filter("col_name = 'Location'").first()["data_type"].rstrip("/")

    def snapshot(self, folder: str | None = None) -> Snapshot:
        """The state now, or at the pointer folder that an earlier publish returned."""
        return Snapshot(self, folder or self.location())

    # ---- writing ----

    def stage(self, frames: dict[str, DataFrame]) -> str:
        """Write rows of one publication to each table, unseen; returns the publication."""
        publication = uuid.uuid4().hex

        def add(item: tuple[str, DataFrame]) -> None:
            name, rows = item
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.declared[name].fields]
            placed = rows.select(*columns, F.lit(publication).alias(PUBLICATION))
            placed.write.insertInto(self.names[name] + ROWS)

        with ThreadPoolExecutor(CONCURRENT_WRITES) as pool:
            list(pool.map(add, frames.items()))
        return publication

    def switch(self, processed: DataFrame, publication: str, analysis_id: str) -> str:
        """Point the processed models at a publication; others keep theirs. Returns the pointer's folder."""
        models = processed.select(schemas.SLICE_COLUMN).distinct()
        new = models.select(
            schemas.SLICE_COLUMN, F.lit(publication).alias(PUBLICATION), F.lit(analysis_id).alias("analysis_id")
        )
        for _ in range(ATTEMPTS):
            base = self.location()
            held = self.snapshot(base).pointers.join(models, schemas.SLICE_COLUMN, "left_anti")
            folder = f"{self._root()}/{uuid.uuid4().hex}"
            held.select(POINTER.names).unionByName(new).write.parquet(folder)
            if self.location() == base:
                self.spark.sql(f"ALTER TABLE {self.pointer} SET LOCATION '{folder}'")
                self.spark.catalog.refreshTable(self.pointer)
                return folder
        raise RuntimeError("Other runs kept changing the current state.")

    def _root(self) -> str:
        """Where pointer folders lie: beside the tables, in the pointer's database."""
        database = self.pointer.rsplit(".", 1)[0] if "." in self.pointer else self.spark.catalog.currentDatabase()
        return self.spark.catalog.getDatabase(database).locationUri.rstrip("/") + "/pointers-" + self.pointer.rsplit(".", 1)[-1]

    def publish(self, frames: dict[str, DataFrame], processed: DataFrame, analysis_id: str) -> str:
        """Replace the slices of the processed models in all tables at once; one without rows is cleared."""
        return self.switch(processed, self.stage(frames), analysis_id)

    def retire(self, keep: tuple[str, ...] = ()) -> dict[str, list[str]]:
        """Drop the partitions that neither the current pointer nor the pointer folders to keep name.

        Not to be run while another run is between stage and switch. Returns what was dropped by table.
        """
        live = None
        for folder in (self.location(), *keep):
            named = self.snapshot(folder).pointers.select(PUBLICATION)
            live = named if live is None else live.unionByName(named)
        live = live.distinct()
        dropped = {}
        for name, view in self.names.items():
            shown = self.spark.sql(f"SHOW PARTITIONS {view}{ROWS}")
            held = shown.select(F.substring_index("partition", "=", -1).alias(PUBLICATION))
            dropped[name] = [r[0] for r in held.join(live, PUBLICATION, "left_anti").collect()]
            for publication in dropped[name]:
                self.spark.sql(f"ALTER TABLE {view}{ROWS} DROP IF EXISTS PARTITION (`{PUBLICATION}` = '{publication}')")
        return dropped
