"""Parsing of evidence values and rank orders."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelsift.functions.text import strip

# Fixed values that results depend on.
SIZE_UNIT_BYTES = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3, "tb": 1024**4}
TRUE_TEXTS = ["true", "1", "yes", "y"]
SEVERITY_RANK = {"CRITICAL": 5, "ERROR": 4, "HIGH": 4, "WARNING": 3, "MEDIUM": 3, "INFO": 2, "LOW": 1}
RISK_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
HIGH_SEVERITIES = ["HIGH", "CRITICAL", "ERROR"]
BYTES_PER_MB = 1048576

SIZE_TEXT = r"(?i)^(-?\d+(?:\.\d+)?)\s*([kmgt]?b)?\z"
EXTRA_TIMESTAMP_FORMATS = ["M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy"]


def drop_nan(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return col


def as_bool(col: Column, kind: T.DataType, default: bool = False) -> Column:
    parsed = col if isinstance(kind, T.BooleanType) else F.lower(strip(col.cast("string"))).isin(TRUE_TEXTS)
    return F.coalesce(parsed, F.lit(default))


def as_number(col: Column, kind: T.DataType) -> Column:
    """Numbers as they are; text such as '1,024.5 MB' in bytes; anything else null."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return drop_nan(col.cast("double"), T.DoubleType())
    text = strip(F.replace(col.cast("string"), F.lit(","), F.lit("")))
    unit = F.lower(F.regexp_extract(text, SIZE_TEXT, 2))
    factor = F.lit(1.0)
    for name, size in SIZE_UNIT_BYTES.items():
        factor = F.when(unit == name, F.lit(float(size))).otherwise(factor)
    return F.regexp_extract(text, SIZE_TEXT, 1).try_cast("double") * factor


def as_int(col: Column, kind: T.DataType) -> Column:
    """Truncates toward zero."""
    if isinstance(kind, T.IntegralType):
        return col.cast("bigint")
    return as_number(col, kind).try_cast("bigint")


def as_timestamp(col: Column, kind: T.DataType) -> Column:
    """UTC instant, null when the value cannot be read as one."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp")
    if isinstance(kind, T.NumericType):
        return F.timestamp_micros((col / 1000).try_cast("bigint"))
    tries = [col.try_cast("timestamp")]
    tries += [F.try_to_timestamp(strip(col), F.lit(f)) for f in EXTRA_TIMESTAMP_FORMATS]
    return F.coalesce(*tries)


def duration_seconds(start: Column, end: Column) -> Column:
    """Fractional seconds, never negative, null when either end is unknown."""
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)
    return F.when(seconds < 0, F.lit(0.0)).otherwise(seconds)


def _rank(col: Column, ranks: dict[str, int]) -> Column:
    label = F.upper(col)
    rank = F.lit(0)
    for value, labels in _by_rank(ranks).items():
        rank = F.when(label.isin(labels), F.lit(value)).otherwise(rank)
    return rank


def _by_rank(ranks: dict[str, int]) -> dict[int, list[str]]:
    grouped: dict[int, list[str]] = {}
    for label, value in ranks.items():
        grouped.setdefault(value, []).append(label)
    return grouped


def severity_rank(col: Column) -> Column:
    return _rank(col, SEVERITY_RANK)


def risk_rank(col: Column) -> Column:
    return _rank(col, RISK_RANK)


def is_high_severity(col: Column) -> Column:
    return F.coalesce(F.upper(col).isin(HIGH_SEVERITIES), F.lit(False))


def megabytes(bytes_sum: Column) -> Column:
    return F.coalesce(bytes_sum / F.lit(float(BYTES_PER_MB)), F.lit(0.0))


def fixed2(col: Column) -> Column:
    """Non-negative double -> text with two decimals, rounded from its binary value.

    Format patterns round the shortest decimal form instead, so 1.005 and 0.125 would differ. The
    value is compared with the midpoint of its two neighbours; splitting it in two halves of 26
    bits keeps every product exact. Half-way values go to the even neighbour.
    """
    hundredths = F.floor(col * 100)
    head = col * F.lit(134217729.0)
    head = head - (head - col)
    above = (head * 200 - (hundredths * 2 + 1)) + (col - head) * 200
    up = (above > 0) | ((above == 0) & (hundredths % 2 == 1))
    cents = hundredths + F.when(up, F.lit(1)).otherwise(F.lit(0))
    return F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
    )
