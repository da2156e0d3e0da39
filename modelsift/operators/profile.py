"""Column storage profile of lake tables, and rules over it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelsift.operators import rules
from modelsift.operators.ranking import union_all

SCALARS = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
FIXED_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8}


def _as_text(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        col = F.when(col == 0, F.lit(0.0)).otherwise(col)  # -0.0 and 0.0 are one value
    return col.cast("string")


def profiled_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, SCALARS) or _is_vector(f.dataType)]


def _is_vector(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and type(kind.elementType) in FIXED_WIDTH


def _value(col: Column, kind: T.DataType) -> Column:
    """-0.0 and 0.0 are one value."""
    return F.when(col == 0, F.lit(0.0)).otherwise(col) if isinstance(kind, (T.DoubleType, T.FloatType)) else col


def _width(col: Column, kind: T.DataType) -> Column:
    """Bytes of the value as text, of a vector those of its elements; null for null."""
    if _is_vector(kind):
        return F.when(col.isNotNull(), F.size(col) * FIXED_WIDTH[type(kind.elementType)])
    return F.octet_length(_as_text(col, kind))


def _types(df: DataFrame) -> Column:
    pairs = [(n, df.schema[n].dataType.simpleString()) for n in profiled_columns(df)]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])[F.col("column_name")]


def distinct_values(df: DataFrame, table: str) -> DataFrame:
    """One row per column and value: the value's width and its count.

    The table is scanned once and shuffled once: each row becomes one narrow row per column. A value is known by
    96 bits of hashes, so whole texts and vectors are hashed in full and never shuffled, and tasks combine by plain
    numbers, so a hot value costs one row per task. Two values of a column fall together with a chance below 1e-9 at ten
    thousand million distinct ones.
    """
    names = profiled_columns(df)
    cells = []
    for i, name in enumerate(names):
        col, kind = F.col(f"`{name}`"), df.schema[name].dataType
        value = _value(col, kind)
        cells.append(
            F.struct(
                F.lit(i).alias("at"), F.xxhash64(value).alias("h"), F.hash(value).alias("g"), _width(col, kind).alias("width")
            )
        )
    shown = [F.array(*[F.lit(x) for x in of]) for of in (names, [df.schema[n].dataType.simpleString() for n in names])]
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("at", "h", "g", "width")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.lit(table).alias("table_name"),
            F.get(shown[0], F.col("at")).alias("column_name"),
            F.get(shown[1], F.col("at")).alias("data_type"),
            "width",
            "n",
        )
    )


def _exact_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """All values of all columns, then one row per column. A null value has no width."""
    return (
        union_all([distinct_values(df, table) for table, df in tables.items() if profiled_columns(df)])
        .groupBy("table_name", "column_name", "data_type")
        .agg(
            F.sum("n").alias("row_count"),
            F.sum(F.when(F.col("width").isNull(), F.col("n")).otherwise(F.lit(0))).alias("null_count"),
            F.count("width").alias("cardinality"),
            F.coalesce(F.sum(F.col("width").cast("bigint")), F.lit(0)).alias("dictionary_size_bytes"),
        )
    )


def _approximate_counts(df: DataFrame, table: str) -> DataFrame:
    """One pass without shuffling values: sketched cardinality, mean width for the dictionary."""
    names = [n for n in profiled_columns(df) if isinstance(df.schema[n].dataType, SCALARS)]
    text = df.select(*[_as_text(F.col(f"`{n}`"), df.schema[n].dataType).alias(n) for n in names])
    measures = []
    for n in names:
        col = F.col(f"`{n}`")
        measures.append(
            F.struct(
                F.lit(n).alias("column_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(col.isNull()).alias("null_count"),
                F.approx_count_distinct(col).alias("cardinality"),
                F.avg(F.octet_length(col)).alias("mean_width"),
            )
        )
    return (
        text.agg(F.array(*measures).alias("columns"))
        .select(F.inline("columns"))
        .select(
            F.lit(table).alias("table_name"),
            "column_name",
            _types(df).alias("data_type"),
            "row_count",
            "null_count",
            "cardinality",
            F.coalesce(F.col("cardinality") * F.col("mean_width"), F.lit(0.0))
            .cast("bigint")
            .alias("dictionary_size_bytes"),
        )
    )


def column_profile(tables: dict[str, DataFrame], model_id: str, approximate: bool = False) -> DataFrame:
    """Storage evidence of every scalar column, and every vector of plain numbers, of the tables of one model.

    Data bytes are those of bit-packed dictionary codes; dictionary bytes those of the distinct values.
    """
    if approximate:
        profile = union_all([_approximate_counts(df, name) for name, df in tables.items()])
    else:
        profile = _exact_counts(tables)
    return _storage(profile, model_id)


def _storage(profile: DataFrame, model_id: str) -> DataFrame:
    """Counted columns as storage evidence of one model."""
    bits = F.length(F.bin(F.greatest(F.col("cardinality"), F.lit(2)) - 1))
    profile = profile.withColumn("data_size_bytes", F.floor((F.col("row_count") * bits + 7) / 8))
    profile = profile.withColumn("total_size_bytes", F.col("data_size_bytes") + F.col("dictionary_size_bytes"))
    # One row per column of the model's tables, so the window is as small as their schemas.
    whole = F.sum("total_size_bytes").over(W.partitionBy("model_id"))
    return profile.withColumn("model_id", F.lit(model_id)).select(
        "model_id",
        "table_name",
        "column_name",
        "data_type",
        "row_count",
        "null_count",
        "cardinality",
        "data_size_bytes",
        "dictionary_size_bytes",
        F.lit(None).cast("bigint").alias("hierarchy_size_bytes"),
        "total_size_bytes",
        F.when(whole > 0, F.lit(100.0) * F.col("total_size_bytes") / whole).alias("model_size_pct"),
    )


SKETCH_BITS = 14  # 2 ** 14 buckets: a standard error of 0.8 %, at most 16 KB a column and part

PART = "table_name string, part string, column_name string, data_type string, row_count bigint, null_count bigint, width_sum bigint, sketch binary"


def part_profile(df: DataFrame, table: str, part: str) -> DataFrame:
    """One row per profiled column of a part of a table: counts, summed width and a sketch of its values.

    One pass; tasks send one row of sketches each, so nothing grows with the part. An empty part gives counts of 0.
    """
    names = profiled_columns(df)
    cells = []
    for name in names:
        col, kind = F.col(f"`{name}`"), df.schema[name].dataType
        value = F.when(col.isNotNull(), F.xxhash64(_value(col, kind)))
        cells.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(kind.simpleString()).alias("data_type"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(col.isNull()).alias("null_count"),
                F.coalesce(F.sum(_width(col, kind).cast("bigint")), F.lit(0)).alias("width_sum"),
                F.hll_sketch_agg(value, SKETCH_BITS).alias("sketch"),
            )
        )
    cells = F.array(*cells) if cells else F.from_json(F.lit("[]"), "array<struct<column_name: string>>")
    return df.agg(cells.alias("cells")).select(F.lit(table).alias("table_name"), F.lit(part).alias("part"), F.inline("cells"))


def merged_parts(parts: DataFrame, model_id: str) -> DataFrame:
    """The column profile of all parts together, from their rows alone; no table is read.

    Distinct values are estimated from the united sketches, never above the number of values; dictionary bytes are that
    many values of mean width. Columns that changed their type between parts have one row per type.
    """
    merged = parts.groupBy("table_name", "column_name", "data_type").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.sum("width_sum").alias("width_sum"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"),
    )
    filled = F.col("row_count") - F.col("null_count")
    cardinality = F.least(F.col("estimate"), filled)
    mean = F.when(filled > 0, F.col("width_sum") / filled).otherwise(F.lit(0.0))
    counted = merged.select(
        "table_name",
        "column_name",
        "data_type",
        "row_count",
        "null_count",
        cardinality.alias("cardinality"),
        F.round(cardinality * mean).cast("bigint").alias("dictionary_size_bytes"),
    )
    return _storage(counted, model_id)


def rule_violations(profile: DataFrame, rule_rows: DataFrame | None = None) -> DataFrame:
    """Rules over a column profile, as rule-violation evidence; the starter rules unless others are landed."""
    return rules.violations(profile, rules.rule_table(profile.sparkSession) if rule_rows is None else rule_rows)
