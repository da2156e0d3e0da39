"""Contract checks: unique keys, intact relationships, declared columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelsift.operators.ranking import by_key_hash


def key_uniqueness(name: str, df: DataFrame, keys: list[str], wide: bool = False) -> DataFrame:
    """One row on how often the declared key repeats. Counts per key are combined before the shuffle.

    wide is for keys such as ids, of which only hashes are shuffled; the keys themselves only where hashes repeat.
    """
    alone = 0
    if wide:
        unique, df, alone = by_key_hash(df, keys)
        df = unique.filter(F.lit(False)) if df is None else df
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    repeated = F.col("n") > 1
    return per_key.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) + F.lit(alone)).alias("row_count"),
        (F.count(F.lit(1)) + F.lit(alone)).alias("distinct_keys"),
        F.count_if(repeated).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("n") - 1)), F.lit(0)).alias("surplus_rows"),
    ).select(F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "*")


def relationship_integrity(
    tables: dict[str, DataFrame], child: str, child_column: str, parent: str, parent_column: str
) -> DataFrame:
    """One row on child rows without a parent. Children are counted per key first, so a hot key is one row."""
    keys = (
        tables[child]
        .filter(F.col(child_column).isNotNull())
        .groupBy(F.col(child_column).alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    parents = tables[parent].select(F.col(parent_column).alias("k")).distinct().withColumn("found", F.lit(True))
    orphan = F.col("found").isNull()
    return (
        keys.join(parents, "k", "left")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
            F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphan_rows"),
            F.count_if(orphan).alias("orphan_keys"),
        )
        .select(
            F.lit(child).alias("child_table"),
            F.lit(child_column).alias("child_column"),
            F.lit(parent).alias("parent_table"),
            F.lit(parent_column).alias("parent_column"),
            "*",
        )
    )


def schema_contract(name: str, df: DataFrame, declared: T.StructType) -> DataFrame:
    """Declared against actual columns, names without regard to case; nulls in required columns are counted.

    One pass over the table, one row per declared or extra column.
    """
    actual = {f.name.lower(): f for f in df.schema.fields}
    wanted = {f.name.lower(): f for f in declared.fields}
    entries: list[Column] = []
    for key in dict.fromkeys([*wanted, *actual]):
        want, have = wanted.get(key), actual.get(key)
        if have is None:
            status = "MISSING"
        elif want is None:
            status = "EXTRA"
        else:
            status = "OK" if want.dataType.simpleString() == have.dataType.simpleString() else "TYPE"
        counted = want is not None and have is not None and not want.nullable
        nulls = F.count_if(F.col(f"`{have.name}`").isNull()) if counted else F.lit(0).cast("bigint")
        entries.append(
            F.struct(
                F.lit(key).alias("column_name"),
                F.lit(want.dataType.simpleString() if want else None).cast("string").alias("declared_type"),
                F.lit(have.dataType.simpleString() if have else None).cast("string").alias("actual_type"),
                F.lit(status).alias("status"),
                nulls.alias("null_rows"),
            )
        )
    checked = df.agg(F.count(F.lit(1)).alias("row_count"), F.array(*entries).alias("columns"))
    return checked.select(F.lit(name).alias("table_name"), "row_count", F.inline("columns"))
