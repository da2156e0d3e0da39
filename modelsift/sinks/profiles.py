"""Column profiles stored by part, so that a new part adds to a table's profile and nothing old is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.operators.profile import PART, merged_parts, part_profile


class ProfileStore:
    """Part profiles in a shared folder, one sub-folder per table and part.

    A part is what was loaded together: a file, a day, a batch; its name is the caller's. Adding a part again replaces it, so
    a load that is repeated after a failure counts once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, table: str, part: str, df: DataFrame) -> None:
        rows = part_profile(df, table, part).drop("table_name", "part")
        rows.coalesce(1).write.mode("overwrite").parquet(self._path(table, part))

    def drop(self, table: str, part: str) -> None:
        """The part counts no longer: its rows are replaced by none."""
        empty = self.spark.createDataFrame([], PART).drop("table_name", "part")
        empty.coalesce(1).write.mode("overwrite").parquet(self._path(table, part))

    def _path(self, table: str, part: str) -> str:
        for name in (table, part):
            if not name or not all(c.isalnum() or c in "_-." for c in name):
                raise ValueError(f"Not a name of a table or part: {name!r}")
        return f"{self.folder}/table_name={table}/part={part}"

    def parts(self) -> DataFrame:
        return self.spark.read.schema(PART).parquet(self.folder)

    def profile(self, model_id: str, tables: list[str] | None = None) -> DataFrame:
        """The profile of the tables as of all parts added; of the tables named, only their folders are read."""
        parts = self.parts()
        return merged_parts(parts if tables is None else parts.filter(F.col("table_name").isin(tables)), model_id)
