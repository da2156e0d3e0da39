"""Rules as rows: conditions over a column profile, landed as a table and evaluated by joins.

A rule holds for a column of a model where all its conditions hold. A condition compares one measure of the profile
with factor * other measure + constant, or with a text. A condition on a measure that the profile lacks, or on a null
value, does not hold; a rule without conditions never holds; rules that repeat in all their columns hold once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = (
    "rule_name string, category string, severity string, description string, "
    "conditions array<struct<measure: string, comparison: string, factor: double, other: string, constant: double, text: string>>"
)
COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")

MOSTLY_NULL_SHARE = 0.9
WIDE_TEXT_BYTES = 64


def number(measure: str, comparison: str, constant: float = 0, factor: float | None = None, other: str | None = None):
    """measure comparison factor * other + constant."""
    return measure, comparison, None if factor is None else float(factor), other, float(constant), None


def text(measure: str, comparison: str, value: str):
    return measure, comparison, None, None, None, value


STARTER_RULES = [
    (
        "Constant column",
        "Performance",
        "Warning",
        "Remove the column or replace it by a constant.",
        [number("cardinality", "=", 1), number("null_count", "=", 0), number("row_count", ">", 1)],
    ),
    (
        "Mostly empty column",
        "Maintenance",
        "Info",
        "Check whether the column is still filled.",
        [number("null_count", ">=", factor=MOSTLY_NULL_SHARE, other="row_count")],
    ),
    (
        "Floating-point key",
        "Performance",
        "Error",
        "Use an integer or decimal type for a column of unique values.",
        [text("data_type", "=", "double"), number("cardinality", "=", factor=1, other="row_count"), number("row_count", ">", 1)],
    ),
    (
        "Wide text column",
        "Performance",
        "Warning",
        "Move long texts out of the model or shorten them.",
        [text("data_type", "=", "string"), number("dictionary_size_bytes", ">", factor=WIDE_TEXT_BYTES, other="cardinality")],
    ),
]


def rule_table(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(STARTER_RULES if rules is None else rules, RULES)


def _compared(left: Column, comparison: Column, right: Column) -> Column:
    by_sign = (left == right, left != right, left < right, left <= right, left > right, left >= right)
    holds = F.lit(False)
    for sign, result in zip(COMPARISONS, by_sign, strict=True):
        holds = F.when(comparison == sign, result).otherwise(holds)
    return F.coalesce(holds, F.lit(False))


def _measured(profile: DataFrame) -> DataFrame:
    """One row per column of the model and measure: its number or its text, and the numbers of all measures."""
    keys = ("model_id", "table_name", "column_name")
    numeric = [f.name for f in profile.schema.fields if isinstance(f.dataType, T.NumericType)]
    texts = [f.name for f in profile.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keys]
    double = lambda n: F.col(n).cast("double")
    absent = {"number": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}
    entry = lambda n, **of: F.struct(F.lit(n).alias("measure"), *[c.alias(k) for k, c in {**absent, **of}.items()])
    measures = [entry(n, number=double(n)) for n in numeric] + [entry(n, text=F.col(n)) for n in texts]
    numbers = F.map_from_arrays(F.array(*[F.lit(n) for n in numeric]), F.array(*[double(n) for n in numeric]))
    return profile.select(*keys, numbers.alias("numbers"), F.inline(F.array(*measures)))


def violations(profile: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule-violation evidence: one row per column of the profile and rule that holds for it.

    Conditions meet the profile on the measure they name. Both sides are as large as schemas and rule books, whatever the tables.
    """
    attributes = ["rule_name", "category", "severity", "description"]
    rules = rules.select(*attributes, "conditions").distinct()
    key = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)
    rules = rules.withColumn("rule_key", key).withColumn("wanted", F.size("conditions"))
    conditions = rules.select("rule_key", "wanted", *attributes, F.inline("conditions")).withColumnRenamed("text", "wanted_text")
    met = _measured(profile).join(conditions, "measure")
    factor, constant = F.coalesce("factor", F.lit(1.0)), F.coalesce("constant", F.lit(0.0))
    right = F.when(F.col("other").isNull(), constant).otherwise(factor * F.col("numbers")[F.col("other")] + constant)
    holds = F.when(F.col("wanted_text").isNotNull(), _compared(F.col("text"), F.col("comparison"), F.col("wanted_text"))).otherwise(
        _compared(F.col("number"), F.col("comparison"), right)
    )
    return (
        met.groupBy("model_id", "table_name", "column_name", "rule_key", "wanted", *attributes)
        .agg(F.count_if(holds).alias("holding"))
        .filter(F.col("holding") == F.col("wanted"))
        .select(
            "model_id",
            F.col("rule_name").alias("Rule Name"),
            F.lit("Column").alias("Object Type"),
            F.col("table_name").alias("Table Name"),
            F.col("column_name").alias("Object Name"),
            F.col("category").alias("Category"),
            F.col("severity").alias("Severity"),
            F.col("description").alias("Description"),
        )
    )
