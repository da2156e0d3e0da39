"""Landed evidence -> rows with logical column names.

Collectors land one row per observation with whatever headings they use, plus bookkeeping columns:
the model (or workspace) the row belongs to, its position in the collector's answer, and when it
was seen. Headings are matched without regard to case and punctuation.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelsift.functions import values as V
from modelsift.functions.text import blank_to_null, canonical_name, strip

BOOKKEEPING = ("workspace_id", "model_id", "source_ordinal", "detected_at")

# The landed row as a struct. It becomes JSON only in rows that are kept.
RAW = "raw_row"

# Accepted headings of each logical column, first match with a value wins.
HEADINGS = {
    "inventory": {
        "model_id": ["id", "item_id", "dataset_id", "semantic_model_id", "model_id"],
        "model_name": ["display_name", "name", "item_name", "dataset_name", "semantic_model_name", "model_name"],
        "is_default_model": ["is_default_model"],
    },
    "workspace_access": {
        "workspace_name": ["Workspace Name", "Name"],
        "principal_type": ["User Type", "Principal Type"],
        "principal_id": ["User Id", "Principal Id", "Graph Id", "Identifier"],
        "principal_details": ["User Details", "Service Principal Details"],
        "workspace_role": ["Workspace Role", "Role", "Group User Access Right"],
    },
    "workspaces": {
        "workspace_id": ["Id", "Workspace Id"],
        "workspace_name": ["Name", "Workspace Name"],
    },
    "rule_violations": {
        "rule_name": ["Rule Name", "Rule", "Name"],
        "object_type": ["Scope", "Object Type", "ObjectType"],
        "table_name": ["Table Name", "Table"],
        "object_name": ["Object Name", "Object", "ObjectName"],
        "description": ["Description", "Finding", "Message"],
        "severity": ["Severity"],
        "category": ["Category"],
        "documentation_url": ["URL", "Documentation URL"],
    },
    "storage_columns": {
        "table_name": ["Table Name", "Table"],
        "column_name": ["Column Name", "Column"],
        "total_size_bytes": ["Total Size", "Total Size Bytes"],
        "data_size_bytes": ["Data Size", "Data Size Bytes"],
        "dictionary_size_bytes": ["Dictionary Size", "Dictionary Size Bytes"],
        "hierarchy_size_bytes": ["Hierarchy Size", "Hierarchy Size Bytes"],
        "cardinality": ["Cardinality", "Column Cardinality"],
        "data_type": ["Data Type", "Type"],
        "encoding": ["Encoding", "Encoding Hint"],
    },
    "storage_tables": {
        "table_name": ["Table Name", "Table"],
        "row_count": ["Row Count", "Rows"],
        "total_size_bytes": ["Total Size", "Total Size Bytes"],
        "data_size_bytes": ["Data Size", "Data Size Bytes"],
        "dictionary_size_bytes": ["Dictionary Size", "Dictionary Size Bytes"],
        "hierarchy_size_bytes": ["Hierarchy Size", "Hierarchy Size Bytes"],
    },
    "storage_partitions": {"mode": ["Mode", "Storage Mode", "Partition Mode"]},
    "refresh_history": {
        "request_id": ["Request Id", "Id", "Refresh Id"],
        "start_time": ["Start Time", "StartTime", "Start Date Time"],
        "end_time": ["End Time", "EndTime", "End Date Time"],
        "refresh_type": ["Refresh Type", "Type"],
        "status": ["Status"],
    },
    "object_usage": {
        "table_name": ["Table Name", "Table"],
        "object_type": ["Object Type", "Type"],
        "object_name": ["Object Name", "Object"],
        "is_used": ["IsUsed", "Is Used"],
        "usage_count": ["UsageCount", "Usage Count"],
    },
    "fallback_reasons": {
        "table_name": ["Table Name", "Table"],
        "reason": ["Fallback Reason", "Reason"],
    },
    "item_access": {
        "principal_id": ["User Id", "Graph Id", "Identifier"],
        "principal_upn": ["User Principal Name", "Email Address"],
        "principal_name": ["User Name", "Name"],
        "principal_type": ["User Type", "Principal Type"],
        "permissions": ["Permissions", "Dataset User Access Right"],
        "additional_permissions": ["Additional Permissions"],
    },
}

# Ids that landing tables share, compared in lower case.
ID_COLUMNS = {"model_id", "workspace_id"}
INTEGERS = {
    "total_size_bytes",
    "data_size_bytes",
    "dictionary_size_bytes",
    "hierarchy_size_bytes",
    "cardinality",
    "row_count",
    "usage_count",
}
TIMESTAMPS = {"start_time", "end_time"}
BOOLEANS = {"is_used": True, "is_default_model": False}


def read_landing(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Landed files. Text formats need a declared schema, so that they are not read twice."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt != "parquet":
        raise ValueError(f"{fmt} evidence needs a schema.")
    return reader.load(path)


def headings(df: DataFrame) -> dict[str, str]:
    """Canonical name -> actual heading; the last of several equal ones wins."""
    return {canonical_name(c): c for c in df.columns}


def with_canonical_names(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{actual}`").alias(name) for name, actual in headings(df).items()])


def _present(df: DataFrame, accepted: list[str]) -> list[str]:
    found = headings(df)
    names = dict.fromkeys(canonical_name(a) for a in accepted)
    return [found[n] for n in names if n in found]


def _value(df: DataFrame, logical: str, actual: str) -> Column:
    kind = df.schema[actual].dataType
    col = V.drop_nan(F.col(f"`{actual}`"), kind)
    if logical in INTEGERS:
        return V.as_int(col, kind)
    if logical in TIMESTAMPS:
        return V.as_timestamp(col, kind)
    if logical in BOOLEANS:
        return F.when(col.isNotNull(), V.as_bool(col, kind))
    return F.lower(col.cast("string")) if logical in ID_COLUMNS else col.cast("string")


def _pick(df: DataFrame, logical: str, accepted: list[str]) -> Column:
    """First accepted heading with a value. A value is chosen before it is parsed."""
    columns = _present(df, accepted)
    if not columns:
        kind = "bigint" if logical in INTEGERS else "timestamp" if logical in TIMESTAMPS else "string"
        picked = F.lit(None).cast("boolean" if logical in BOOLEANS else kind)
    else:
        has_value = [V.drop_nan(F.col(f"`{c}`"), df.schema[c].dataType).isNotNull() for c in columns]
        parsed = [_value(df, logical, c) for c in columns]
        if len(columns) == 1:
            picked = parsed[0]
        else:
            picked = reduce(
                lambda rest, pair: F.when(pair[0], pair[1]).otherwise(rest),
                reversed(list(zip(has_value, parsed))[:-1]),
                parsed[-1],
            )
    if logical in BOOLEANS:
        picked = F.coalesce(picked, F.lit(BOOLEANS[logical]))
    return picked


def evidence(df: DataFrame, kind: str, raw: bool = True) -> DataFrame:
    """Project landed rows to bookkeeping + logical columns (+ the whole row as a struct)."""
    keep = [c for c in BOOKKEEPING if c in df.columns and c not in HEADINGS[kind]]
    columns = [
        F.col(c).cast("timestamp").alias(c)
        if c == "detected_at"
        else (F.lower(c).alias(c) if c in ID_COLUMNS else F.col(c))
        for c in keep
    ]
    columns += [_pick(df, name, accepted).alias(name) for name, accepted in HEADINGS[kind].items()]
    if raw:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in BOOKKEEPING]).alias(RAW))
    return df.select(*columns)


def workspaces(df: DataFrame) -> DataFrame:
    """(workspace_id, workspace_name) of a workspace listing under its own headings; ids in lower case."""
    return df.select(*[_pick(df, name, accepted).alias(name) for name, accepted in HEADINGS["workspaces"].items()]).select(
        F.lower("workspace_id").alias("workspace_id"), blank_to_null(strip(F.col("workspace_name"))).alias("workspace_name")
    )


def inventory(df: DataFrame) -> DataFrame:
    """Models per workspace; an inventory without id or name column cannot be used."""
    for logical in ("model_id", "model_name"):
        if not _present(df, HEADINGS["inventory"][logical]):
            raise ValueError(f"No ID/name heading for {logical} among those of the inventory: {df.columns}")
    extra = [c for c in ("workspace_name",) if c in df.columns]
    return df.select(
        F.lower("workspace_id").alias("workspace_id"),
        F.lower(_pick(df, "model_id", HEADINGS["inventory"]["model_id"])).alias("model_id"),
        *[_pick(df, n, HEADINGS["inventory"][n]).alias(n) for n in ("model_name", "is_default_model")],
        *[blank_to_null(strip(F.col(c))).alias(c) for c in extra],
    )
