"""The sample tables seen as landed evidence (FIXTURES.md section 4).

Regions stand for workspaces and nations for models; customers and suppliers stand for a larger
estate of models and principals. Headings vary on purpose, as collectors' do.
"""

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelsift.config import STAGES, ScanConfig
from modelsift.functions.text import stable_id
from modelsift.operators.merge import EXPLICIT_SOURCE
from modelsift.operators.usage import unused_objects
from modelsift.operators import contracts, rules
from modelsift.plans.scan import Scan
from modelsift.session import written

GUID_PREFIX = "00000000-0000-4000-8000-"
SCANNER_GUID = GUID_PREFIX + "000000009001"
SCAN_ID = "fixture-scan-0001"
PRIOR_SCAN_ID = "fixture-scan-0000"
CLOCK = datetime(2024, 2, 1, tzinfo=timezone.utc)
PRIOR_CLOCK = datetime(2024, 1, 31, tzinfo=timezone.utc)
LINES_PER_TASK = 500_000


# Columns of the sample tables. Declared, so that reading starts no schema job. The profile reads the
# files' own schemas.
SAMPLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def guid(number: Column) -> Column:
    return F.concat(F.lit(GUID_PREFIX), F.lpad(number.cast("string"), 12, "0"))


def model_guid(nation: str) -> Column:
    return guid(F.col(nation) + 1000)


def scan_config(**changes) -> ScanConfig:
    settings = dict(
        scan_id=SCAN_ID,
        started_at=CLOCK,
        completed_at=CLOCK,
        workspace_ids=tuple(f"{GUID_PREFIX}{n:012d}" for n in range(5)),
        auth_mode="spn_secret",
        scanner_object_id=SCANNER_GUID,
        profile="deep",
        requested_by="Owner@Example.com",
    )
    return ScanConfig(**{**settings, **changes})


@dataclass(frozen=True)
class SampleTables:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SAMPLE_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def whole(self, name: str) -> DataFrame:
        """A table with all columns that its files have, for queries whose job is to look at columns."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table whose rows are used one by one, split by key when it has fewer files than cores.

        A small file is a single row group, which one task would read and process to the end. A large
        table comes in many files and is read as it lies. AQE chooses the number of parts by their size: a fixed
        number would let each grow with the table.
        """
        df = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(F.col(key)) if len(df.inputFiles()) < cores else df

    @cached_property
    def inventory(self) -> DataFrame:
        key = F.col("n_nationkey")
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                guid(F.col("n_regionkey")).alias("workspace_id"),
                F.col("r_name").alias("workspace_name"),
                model_guid("n_nationkey").alias("Dataset Id"),
                F.when(key == 24, "ModelBPA").otherwise(F.col("n_name")).alias("Dataset Name"),
                (key % 11 == 10).alias("is_default_model"),
                F.when(key % 3 == 0, "DirectLake")
                .when(key % 3 == 1, "Import")
                .otherwise("Import, DirectQuery")
                .alias("storage_mode"),
            )
        )

    @cached_property
    def workspace_access(self) -> DataFrame:
        key = F.col("r_regionkey")
        return (
            self.table("region")
            .filter(key != 3)
            .select(
                guid(key).alias("workspace_id"),
                F.col("r_name").alias("Workspace Name"),
                F.lit("ServicePrincipal").alias("Principal Type"),
                F.lit(SCANNER_GUID).alias("Principal Id"),
                F.when(key == 4, "Viewer").otherwise("Contributor").alias("Workspace Role"),
            )
        )

    @cached_property
    def workspaces(self) -> DataFrame:
        return self.table("region").select(
            guid(F.col("r_regionkey")).alias("workspace_id"), F.col("r_name").alias("workspace_name")
        )

    @cached_property
    def capacity(self) -> DataFrame:
        return self.workspaces.select(
            "workspace_id",
            F.col("workspace_id").alias("capacity_id"),
            F.col("workspace_name").alias("capacity_name"),
        )

    @cached_property
    def rule_lines(self) -> DataFrame:
        """The lines with their customer's model. Orders meet customers first: lines are shuffled once, by order."""
        ordered = (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "c_nationkey")
        )
        lines = self.spread("lineitem", "l_orderkey").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"
        )
        joined = lines.join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.withColumn("model_id", model_guid("c_nationkey")).drop("o_orderkey", "c_nationkey")

    def hold_lines(self) -> None:
        """Write the rule lines, for a query that reads them several times; before it plans anything of them."""
        if "lines_held" not in self.__dict__:
            self.__dict__.update(rule_lines=written(self.rule_lines, "rule-lines"), lines_held=True)
            for name in ("rule_violations", "refresh_history"):
                self.__dict__.pop(name, None)

    def hold(self, name: str) -> None:
        """Write a kind of evidence, for a query that reads it several times; before it plans anything of it."""
        if f"{name}_held" not in self.__dict__:
            self.__dict__.update({name: written(getattr(self, name), name.replace("_", "-")), f"{name}_held": True})

    @cached_property
    def rule_violations(self) -> DataFrame:
        line, part, supplier = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
        return (
            self.rule_lines.select(
                (F.col("l_orderkey") * 10 + line).alias("source_ordinal"),
                "model_id",
                F.concat(F.lit("Rule "), line.cast("string")).alias("Rule Name"),
                F.when(F.col("l_returnflag") == "A", "Performance")
                .when(F.col("l_returnflag") == "R", "Formatting")
                .alias("Category"),
                F.when(supplier % 5 == 0, "Error")
                .when(supplier % 5 == 1, " warning ")
                .when(supplier % 5 == 2, "Info")
                .when(supplier % 5 == 3, "bogus")
                .alias("Severity"),
                F.when(F.col("l_linestatus") == "F", "Column").otherwise("Measure").alias("Object Type"),
                F.concat(F.lit("table_"), supplier.cast("string")).alias("Table Name"),
                F.concat(F.lit("object_"), part.cast("string")).alias("Object Name"),
                F.when(part % 7 != 0, F.concat(F.lit("Review rule "), line.cast("string"))).alias("Description"),
                F.lit(None).cast("string").alias("URL"),
                F.col("l_shipdate").alias("detected_at"),
            )
        )

    @cached_property
    def column_groups(self) -> DataFrame:
        """One row per model column: a supplier is a table, a part number modulo 50 a column.

        Written once for all storage evidence and the model's objects. The lines of a column are brought together by
        one shuffle, in which its orders are counted, too; suppliers are joined to the columns. A task gets about
        LINES_PER_TASK lines whatever the table's size.
        """
        table = self.table("lineitem")
        parts = max(self.spark.sparkContext.defaultParallelism, -(-table.count() // LINES_PER_TASK))
        lines = (
            table
            .filter(F.col("l_suppkey").isNotNull())
            .select("l_suppkey", (F.col("l_partkey") % 50).alias("slot"), "l_orderkey", "l_quantity", "l_linenumber")
            .repartition(parts, "l_suppkey", "slot")
        )
        columns = lines.groupBy("l_suppkey", "slot").agg(
            F.count_distinct("l_orderkey").alias("orders"),
            F.sum("l_quantity").alias("quantity"),
            F.sum("l_linenumber").alias("lines"),
            F.count(F.lit(1)).alias("n"),
        )
        # A supplier that is listed several times has its lines as often.
        suppliers = self.table("supplier").groupBy("s_suppkey", "s_nationkey").agg(F.count(F.lit(1)).alias("times"))
        times = F.col("times")
        found = columns.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
            "s_nationkey",
            "l_suppkey",
            "slot",
            "orders",
            (F.col("quantity") * times).cast("bigint").alias("quantity"),
            (F.col("lines") * times).alias("lines"),
            (F.col("n") * times).alias("n"),
        )
        return written(found, "column-groups").select(
            "s_nationkey",
            model_guid("s_nationkey").alias("model_id"),
            F.concat(F.lit("table_"), F.col("l_suppkey").cast("string")).alias("Table Name"),
            "slot",
            "orders",
            "quantity",
            "lines",
            "n",
            (
                F.col("n")
                * 9437184
                * F.when(F.col("slot") == 7, F.col("l_suppkey") % 3 * 40 + 1).otherwise(F.lit(1))
            ).alias("Total Size"),
        )

    @cached_property
    def storage_columns(self) -> DataFrame:
        slot = F.col("slot")
        return self.column_groups.select(
            "model_id",
            "Table Name",
            F.concat(F.lit("object_"), slot.cast("string")).alias("Column Name"),
            F.when(slot % 4 == 0, "DateTime")
            .when(slot % 4 == 1, "String")
            .when(slot % 4 == 2, "Int64")
            .otherwise("Double")
            .alias("Data Type"),
            F.when(slot % 2 == 0, "HASH").otherwise("VALUE").alias("Encoding"),
            (F.col("orders") * 100000).alias("Cardinality"),
            F.concat(F.col("quantity").cast("string"), F.lit(" KB")).alias("Data Size"),
            (F.col("lines") * 4096).alias("Dictionary Size"),
            F.lit(None).cast("bigint").alias("Hierarchy Size"),
            "Total Size",
        )

    @cached_property
    def storage_tables(self) -> DataFrame:
        """One row per table: its columns' rows and sizes summed."""
        return self.column_groups.groupBy("model_id", "Table Name").agg(
            F.sum("n").alias("Rows"),
            F.sum("Total Size").alias("Total Size"),
            F.concat(F.sum("quantity").cast("string"), F.lit(" KB")).alias("Data Size"),
            F.sum(F.col("lines") * 4096).alias("Dictionary Size"),
            F.lit(None).cast("bigint").alias("Hierarchy Size"),
        )

    @cached_property
    def storage_partitions(self) -> DataFrame:
        """Every table of a model has one partition per mode of that model."""
        inventory = self.inventory.select(F.col("Dataset Id").alias("model_id"), "storage_mode")
        return (
            self.table("supplier")
            .select(model_guid("s_nationkey").alias("model_id"), F.col("s_suppkey").alias("source_ordinal"))
            .join(inventory, "model_id")
            .select("model_id", "source_ordinal", F.explode(F.split("storage_mode", ",")).alias("Storage Mode"))
        )

    @cached_property
    def model_size(self) -> DataFrame:
        return self.column_groups.groupBy("model_id").agg(F.sum("Total Size").alias("model_size_bytes"))

    @cached_property
    def usage_log(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            "ts",
            guid(F.col("user_id") % 25 + 1000).alias("model_id"),
            F.concat(F.lit("table_"), (F.col("user_id") % 100).cast("string")).alias("table_name"),
            F.concat(F.lit("object_"), (F.col("event_id") % 50).cast("string")).alias("object_name"),
            "event_type",
        )

    @cached_property
    def model_objects(self) -> DataFrame:
        return (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select("s_nationkey", "l_suppkey", (F.col("l_partkey") % 50).alias("slot"))
            .distinct()
            .select(
                model_guid("s_nationkey").alias("model_id"),
                F.concat(F.lit("table_"), F.col("l_suppkey").cast("string")).alias("table_name"),
                F.lit("Column").alias("object_type"),
                F.concat(F.lit("object_"), F.col("slot").cast("string")).alias("object_name"),
            )
        )

    @cached_property
    def object_usage(self) -> DataFrame:
        objects = self.column_groups.select(
            "model_id",
            F.col("Table Name").alias("table_name"),
            F.lit("Column").alias("object_type"),
            F.concat(F.lit("object_"), F.col("slot").cast("string")).alias("object_name"),
        )
        used = unused_objects(objects, self.usage_log, CLOCK, days=14)
        return used.select(
            "model_id",
            F.col("table_name").alias("Table Name"),
            F.col("object_type").alias("Object Type"),
            F.col("object_name").alias("Object Name"),
            F.col("is_used").alias("IsUsed"),
            F.col("usage_count").alias("UsageCount"),
        )

    @cached_property
    def refresh_history(self) -> DataFrame:
        # Written rule lines lie by order, so their tasks send one row per order; they have the lines of all orders shown.
        lines = self.rule_lines if "lines_held" in self.__dict__ else self.table("lineitem")
        last_line = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ended"))
        return (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(last_line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(
                F.col("o_orderkey").alias("source_ordinal"),
                model_guid("c_nationkey").alias("model_id"),
                F.when(
                    F.col("o_orderkey") % 10 != 0, F.concat(F.lit("req-"), F.col("o_orderkey").cast("string"))
                ).alias("Request Id"),
                F.col("o_orderpriority").alias("Refresh Type"),
                F.when(F.col("o_orderstatus") == "F", "Failed")
                .when(F.col("o_orderstatus") == "O", "Completed")
                .otherwise("Unknown")
                .alias("Status"),
                F.col("o_orderdate").alias("Start Time"),
                F.col("ended").alias("End Time"),
            )
        )

    @cached_property
    def fallback_reasons(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("source_ordinal"),
            model_guid("s_nationkey").alias("model_id"),
            F.concat(F.lit("table_"), key.cast("string")).alias("Table"),
            F.when(key % 5 == 0, "None")
            .when(key % 5 == 1, "no fallback")
            .when(key % 5 == 3, "View-based table")
            .when(key % 5 == 4, "Row level security")
            .alias("Fallback Reason"),
        )

    @cached_property
    def item_access(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("source_ordinal"),
            model_guid("c_nationkey").alias("model_id"),
            F.col("c_name").alias("User Name"),
            F.when(key % 3 == 0, "User").when(key % 3 == 1, "Group").otherwise("ServicePrincipal").alias("User Type"),
            F.when(key % 3 == 0, F.concat(F.col("c_name"), F.lit("@Example.com"))).alias("User Principal Name"),
            F.col("c_mktsegment").alias("Permissions"),
        )

    @cached_property
    def stage_errors(self) -> DataFrame:
        nation, key = self.table("nation"), F.col("n_nationkey")

        def failing(condition: Column, stage: str, message: str) -> DataFrame:
            return nation.filter(condition).select(
                model_guid("n_nationkey").alias("model_id"), F.lit(stage).alias("stage"), F.lit(message).alias("message")
            )

        return (
            failing(key % 8 == 5, "bpa", "429 Too Many Requests")
            .unionByName(failing(key % 16 == 5, "vpa", "operation timed out"))
            .unionByName(failing(key % 9 == 1, "refresh", "403 Forbidden"))
        )

    @cached_property
    def error_log(self) -> DataFrame:
        kind = F.col("event_id") % 6
        return (
            self.table("events")
            .filter(F.col("event_type") == "error")
            .select(
                "event_id",
                F.when(kind == 0, "HTTP 401 Unauthorized")
                .when(kind == 1, "403 Forbidden")
                .when(kind == 2, "429 Too Many Requests")
                .when(kind == 3, "operation timed out")
                .when(kind == 4, "item does not exist")
                .otherwise("boom 503")
                .alias("message"),
            )
        )

    @cached_property
    def held_grants(self) -> DataFrame:
        """The access table before the run: users with access, some by explicit request."""
        access = self.item_access.filter(F.col("User Principal Name").isNotNull())
        upn = F.lower("User Principal Name")
        source = F.when(F.col("source_ordinal") % 2 == 0, EXPLICIT_SOURCE).otherwise("MANUAL")
        before = F.lit(PRIOR_CLOCK).cast("timestamp")
        inventory = self.inventory.select("workspace_id", F.col("Dataset Id").alias("model_id"))
        return access.join(inventory, "model_id").select(
            stable_id(F.col("model_id"), upn, source).alias("access_key"),
            "workspace_id",
            "model_id",
            upn.alias("principal_upn"),
            source.alias("source"),
            (F.col("source_ordinal") % 5 != 0).alias("is_active"),
            before.alias("valid_from"),
            F.lit(None).cast("timestamp").alias("valid_to"),
            F.lit("previous@example.com").alias("updated_by"),
            before.alias("updated_at"),
        )

    @cached_property
    def grant_requests(self) -> DataFrame:
        """Landed requests: a model and viewers as separated text; some requests name nobody."""
        key = F.col("source_ordinal")
        upn = F.concat(F.col("User Name"), F.lit("@Example.com"))
        asked = (key % 12 == 0) | (key % 3 == 1)
        return self.item_access.select(
            "model_id", F.when(asked, F.concat(F.lit(" "), upn, F.lit("; "), F.upper(upn))).otherwise("").alias("viewers")
        )

    # ---- a larger estate: nations as workspaces, customers as models, suppliers as principals ----

    @cached_property
    def estate_inventory(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            guid(F.col("c_nationkey")).alias("workspace_id"),
            guid(key + 100000).alias("Item Id"),
            F.when(key % 100 == 7, F.lit(" fabric CAPACITY metrics "))
            .otherwise(F.col("c_name"))
            .alias("Display Name"),
            (key % 9 == 4).alias("is_default_model"),
        )

    @cached_property
    def estate_access(self) -> DataFrame:
        """Principals of each workspace. The scanner appears among them, sometimes only in the details."""
        key = F.col("s_suppkey")
        scanner = key % 4 == 1
        return self.table("supplier").select(
            guid(F.col("s_nationkey")).alias("workspace_id"),
            key.alias("source_ordinal"),
            F.when(key % 2 == 1, F.concat(F.lit("Workspace "), F.col("s_nationkey").cast("string"))).alias("Name"),
            F.when(key % 3 == 0, "User").when(key % 3 == 1, "Service Principal").otherwise("App").alias("User Type"),
            F.when(scanner & (key % 8 == 1), F.lit(SCANNER_GUID.upper())).otherwise(guid(key + 5000)).alias("Graph Id"),
            F.when(scanner, F.concat(F.lit('{"objectId":"'), F.lit(SCANNER_GUID), F.lit('"}'))).alias("User Details"),
            F.when(key % 5 == 0, "Viewer").when(key % 5 == 1, "member").when(key % 5 == 2, "Admin").alias("Role"),
        )

    @cached_property
    def estate_workspaces(self) -> DataFrame:
        return self.table("nation").select(
            guid(F.col("n_nationkey")).alias("workspace_id"), F.col("n_name").alias("workspace_name")
        )


class QuietTables(SampleTables):
    """The sample tables as a scan without stage failures saw them."""

    @cached_property
    def stage_errors(self) -> DataFrame:
        return SampleTables(self.spark, self.folder).stage_errors.filter(F.lit(False))

    @cached_property
    def rule_lines(self) -> DataFrame:
        return sample_scan(self.spark, self.folder).landed.landed.rule_lines

    @cached_property
    def column_groups(self) -> DataFrame:
        return sample_scan(self.spark, self.folder).landed.landed.column_groups

    @cached_property
    def object_usage(self) -> DataFrame:
        return sample_scan(self.spark, self.folder).landed.landed.object_usage

    @cached_property
    def refresh_history(self) -> DataFrame:
        return sample_scan(self.spark, self.folder).landed.landed.refresh_history


def outcomes_of(inventory: DataFrame, errors: DataFrame) -> DataFrame:
    """(model_id, stage, status, message) of every model and stage, as collectors with these errors land them."""
    models = inventory.select(F.col("Dataset Id").alias("model_id"), F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    return models.join(errors, ["model_id", "stage"], "left").select(
        "model_id", "stage", F.when(F.col("message").isNull(), "SUCCEEDED").otherwise("FAILED").alias("status"), "message"
    )


def uncollected(inventory: DataFrame) -> DataFrame:
    """(model_id, stage): refresh histories that were never collected, of one model in seven."""
    number = F.substring("Dataset Id", -6, 6).cast("int") - 1000
    unlucky = (number % 7 == 3) & (number % 9 != 1)
    return inventory.filter(unlucky).select(F.col("Dataset Id").alias("model_id"), F.lit("refresh").alias("stage"))


# What a consumer expects of some sample tables: type and whether a value is required. One expected
# column does not exist and one has another type, as happens in practice.
EXPECTED_COLUMNS = {
    "customer": {
        "c_custkey": ("bigint", True),
        "c_name": ("string", True),
        "c_nationkey": ("int", True),
        "c_phone": ("string", False),
    },
    "orders": {
        "o_orderkey": ("bigint", True),
        "o_custkey": ("bigint", True),
        "o_orderdate": ("date", True),
        "o_totalprice": ("double", True),
    },
    "lineitem": {"l_orderkey": ("bigint", True), "l_linenumber": ("int", True), "l_quantity": ("double", True)},
    "events": {"event_id": ("bigint", True), "ts": ("timestamp_ntz", True), "props": ("string", True)},
    "labels": {"doc_id": ("bigint", True), "quality": ("int", True), "toxic": ("int", True)},
}


def expected_schema(table: str) -> T.StructType:
    ddl = [f"{n} {t}{' NOT NULL' if required else ''}" for n, (t, required) in EXPECTED_COLUMNS[table].items()]
    return T.StructType.fromDDL(", ".join(ddl))


# Contracts of the sample tables: the first version is what they hold, the second what their readers ask for.
CONTRACTS = {
    1: SAMPLE_SCHEMAS,
    2: {
        "region": "r_regionkey int not null, r_name string not null",
        "nation": "n_nationkey int not null, n_name string not null, n_regionkey bigint not null",
        "customer": "c_custkey bigint not null, c_name string not null, c_nationkey bigint not null, c_phone string, c_acctbal double",
        "supplier": "s_suppkey bigint not null, s_name string not null, s_nationkey int not null, s_acctbal decimal(12,2)",
        "part": "p_partkey bigint not null, p_name string, p_brand string, p_type string, p_size bigint, p_retailprice double",
        "orders": "o_orderkey bigint not null, o_custkey bigint not null, o_orderdate date not null, o_totalprice double not null",
        "lineitem": (
            "l_orderkey bigint not null, l_linenumber decimal(10,0) not null, l_quantity double not null, l_shipmode string not null"
        ),
        "events": (
            "event_id bigint not null, ts timestamp_ntz not null, user_id int, event_type string not null, "
            "value double not null, props string not null"
        ),
        "documents": (
            "doc_id bigint not null, text string not null, lang string not null, source string not null, n_chars bigint not null"
        ),
        "embeddings": "vec_id bigint not null, embedding array<double> not null, label int",
        "pages": "page_id bigint not null, url string not null, html string not null",
        "benchmark": "item_id bigint not null, text string not null",
        "labels": "doc_id bigint not null, quality bigint not null, toxic int not null",
        "conversations": "conv_id bigint not null, turn bigint not null, role string not null, text string not null",
    },
}


def sample_contract(spark: SparkSession) -> DataFrame:
    """Both versions as rows of one contract table."""
    by_version = {v: {t: T.StructType.fromDDL(ddl) for t, ddl in tables.items()} for v, tables in CONTRACTS.items()}
    return contracts.contract_table(spark, [r for v, tables in by_version.items() for r in contracts.contract_rows(v, tables)])


# Two rules beside the starter ones, as a user lands them.
LANDED_RULES = [
    (
        "Dictionary outweighs data",
        "Performance",
        "Warning",
        "Values are long for how often they repeat.",
        [rules.number("dictionary_size_bytes", ">", factor=2, other="data_size_bytes"), rules.number("cardinality", ">=", 10)],
    ),
    (
        "Small category",
        "Maintenance",
        "Info",
        "Consider a lookup table.",
        [
            rules.text("data_type", "=", "string"),
            rules.number("cardinality", "<=", factor=0.01, other="row_count", constant=1),
            rules.number("null_count", "<", 1),
        ],
    ),
]

_SCANS: dict[tuple, Scan] = {}


def sample_scan(spark: SparkSession, folder: str, **changes) -> Scan:
    """A scan over the sample tables. Its plans are lazy and hold no data, so they are built once."""
    key = (spark.sparkContext.applicationId, id(spark), folder, tuple(sorted(changes.items())))
    if key not in _SCANS:
        _SCANS[key] = Scan(spark, SampleTables(spark, folder), scan_config(**changes))
    return _SCANS[key]


def holding_scan(spark: SparkSession, folder: str, *kinds: str) -> Scan:
    """sample_scan for a query that reads the findings or their evidence several times; kinds are written, too."""
    scan = sample_scan(spark, folder)
    if "findings" not in scan.pinned:
        scan.landed.landed.hold_lines()
        for kind in kinds:
            scan.landed.landed.hold(kind)
    return scan


def prior_scan(spark: SparkSession, folder: str) -> Scan:
    """The scan before: run as a user, with no stage failing."""
    key = (spark.sparkContext.applicationId, id(spark), folder, "prior")
    if key not in _SCANS:
        config = scan_config(
            scan_id=PRIOR_SCAN_ID, started_at=PRIOR_CLOCK, completed_at=PRIOR_CLOCK, auth_mode="user"
        )
        _SCANS[key] = Scan(spark, QuietTables(spark, folder), config)
    return _SCANS[key]


def forget() -> None:
    """Drop the plans and written tables of earlier queries, so that the next one starts from the evidence."""
    _SCANS.clear()
