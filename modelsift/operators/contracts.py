"""Versioned schema contracts as rows, checked against tables column by column, nested fields included.

A contract row declares one place of a table: a column, a field of a struct (`a.b`), the elements of an array
(`a.element`) or the keys and values of a map (`a.key`, `a.value`), with its type and whether it is required. Names are
compared without regard to case. A place is

- OK: its type is the declared one; or it is optional and absent; or it is not declared at all;
- WIDENED: every value that its type can hold also fits the declared type, so readers of the contract widen it;
- BROKEN: any other type, a required place that is absent, or nulls in a required place. A null counts where it
  stands: a field of a null struct or an element of a null array is no null of that field or element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelsift.operators.ranking import union_all

CONTRACT = "contract_version int, table_name string, path array<string>, declared_type string, required boolean"

# Type -> the types that hold each of its values exactly.
WIDER = {
    "tinyint": {"smallint", "int", "bigint", "float", "double"},
    "smallint": {"int", "bigint", "float", "double"},
    "int": {"bigint", "double"},
    "float": {"double"},
    "date": {"timestamp_ntz"},
}
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}

Place = tuple[str, ...]


def places(kind: T.DataType, at: Place = (), required: bool = False) -> dict[Place, tuple[str, bool]]:
    """Place -> (type, required) of a schema. Nested types are named by their kind, as their parts have rows of their own."""
    if isinstance(kind, T.StructType):
        found = {at: ("struct", required)} if at else {}
        for f in kind.fields:
            found |= places(f.dataType, (*at, f.name.lower()), not f.nullable)
        return found
    if isinstance(kind, T.ArrayType):
        return {at: ("array", required)} | places(kind.elementType, (*at, "element"), not kind.containsNull)
    if isinstance(kind, T.MapType):
        found = {at: ("map", required)} | places(kind.keyType, (*at, "key"), False)
        return found | places(kind.valueType, (*at, "value"), not kind.valueContainsNull)
    return {at: (kind.simpleString(), required)}


def contract_rows(version: int, schemas: dict[str, T.StructType]) -> list[tuple]:
    return [
        (version, table, list(at), kind, required)
        for table, schema in schemas.items()
        for at, (kind, required) in places(schema).items()
    ]


def contract_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CONTRACT)


def fits(actual: str, declared: str) -> bool:
    """Whether every value of the one type is one of the other, too."""
    if declared in WIDER.get(actual, ()):
        return True
    if declared.startswith("decimal("):
        digits, scale = map(int, declared[8:-1].split(","))
        if actual.startswith("decimal("):
            have, have_scale = map(int, actual[8:-1].split(","))
            return scale >= have_scale and digits - scale >= have - have_scale
        return actual in DIGITS and digits - scale >= DIGITS[actual]
    return False


def verdict(declared: tuple[str, bool] | None, actual: str | None) -> tuple[str, str]:
    """(status, reason) of a place, before its nulls are counted."""
    if declared is None:
        return "OK", "undeclared"
    kind, required = declared
    if actual is None:
        return ("BROKEN", "missing") if required else ("OK", "absent")
    if kind == actual:
        return "OK", ""
    return ("WIDENED", "narrower") if fits(actual, kind) else ("BROKEN", "type")


def _nulls(value: Column, kind: T.DataType, rest: Place) -> Column:
    """How many nulls stand at a place of one row."""
    if not rest:
        return F.when(value.isNull(), 1).otherwise(0).cast("bigint")
    if isinstance(kind, T.StructType):
        field = next(f for f in kind.fields if f.name.lower() == rest[0])
        inner = _nulls(value.getField(field.name), field.dataType, rest[1:])
        return F.when(value.isNull(), F.lit(0).cast("bigint")).otherwise(inner)
    if isinstance(kind, T.ArrayType):
        many, part = value, kind.elementType
    elif rest[0] == "key":
        many, part = F.map_keys(value), kind.keyType
    else:
        many, part = F.map_values(value), kind.valueType
    counted = F.aggregate(many, F.lit(0).cast("bigint"), lambda n, x: n + _nulls(x, part, rest[1:]))
    return F.coalesce(counted, F.lit(0).cast("bigint"))


def _field(schema: T.StructType, name: str) -> T.StructField:
    return next(f for f in schema.fields if f.name.lower() == name)


def _checked(name: str, df: DataFrame, declared: dict[Place, tuple[str, bool]], version: int) -> DataFrame:
    actual = places(df.schema)
    entries = []
    for at in sorted({*declared, *actual}):
        want, have = declared.get(at), actual.get(at, (None,))[0]
        status, reason = verdict(want, have)
        nulls = F.lit(0).cast("bigint")
        if want is not None and want[1] and have is not None:
            field = _field(df.schema, at[0])
            nulls = F.coalesce(F.sum(_nulls(F.col(f"`{field.name}`"), field.dataType, at[1:])), nulls)
        entries.append(
            F.struct(
                F.lit(".".join(at)).alias("column_path"),
                F.lit(want[0] if want else None).cast("string").alias("declared_type"),
                F.lit(have).cast("string").alias("actual_type"),
                F.lit(status).alias("status"),
                F.lit(reason).alias("reason"),
                nulls.alias("null_values"),
            )
        )
    checked = df.agg(F.count(F.lit(1)).alias("row_count"), F.array(*entries).alias("places"))
    settled = (F.col("null_values") == 0) | (F.col("status") == "BROKEN")
    return checked.select("row_count", F.inline("places")).select(
        F.lit(name).alias("table_name"),
        F.lit(version).cast("int").alias("contract_version"),
        "row_count",
        "column_path",
        "declared_type",
        "actual_type",
        F.when(settled, F.col("status")).otherwise("BROKEN").alias("status"),
        F.when(settled, F.col("reason")).otherwise("nulls").alias("reason"),
        "null_values",
    )


def contract_check(tables: dict[str, DataFrame], contract: DataFrame, version: int | None = None) -> DataFrame:
    """One row per declared or stored place of every table, under a version of its contract (its latest by default).

    One pass over each table, which reads its required columns only. The contract's rows of these tables come to the
    driver: they are as many as the tables have declared places. A table without a contract has version 0.
    """
    named = contract.filter(F.col("table_name").isin(list(tables)))
    named = named.filter(F.col("contract_version") == version) if version is not None else named
    versions: dict[str, dict[int, dict]] = {name: {} for name in tables}
    for r in named.collect():
        declared = versions[r.table_name].setdefault(r.contract_version, {})
        declared[tuple(p.lower() for p in r.path)] = (r.declared_type, bool(r.required))
    checks = []
    for name, df in tables.items():
        latest = max(versions[name], default=0)
        checks.append(_checked(name, df, versions[name].get(latest, {}), latest))
    return union_all(checks)


def contract_changes(old: T.StructType, new: T.StructType) -> dict[str, tuple[str, str]]:
    """Place -> (status, reason): whether data written under the old schema still fits the new one, by the same rules."""
    before, after = places(old), places(new)
    found = {}
    for at in sorted({*before, *after}):
        want, had = after.get(at), before.get(at)
        status, reason = verdict(want, had[0] if had else None)
        if status != "BROKEN" and want and had and want[1] and not had[1]:
            status, reason = "BROKEN", "required"
        found[".".join(at)] = (status, reason)
    return found
