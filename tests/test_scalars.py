import hashlib
import random
import re
import uuid
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import one
from modelsift.functions import messages as M
from modelsift.functions import text as X
from modelsift.functions import values as V

STRING, DOUBLE = T.StringType(), T.DoubleType()


def over(spark, values, kind, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)]))
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_stable_id_keeps_the_place_of_null_parts(spark):
    got = one(spark, a=X.stable_id("s", None, 3, ""), b=X.stable_id("s", 3))
    assert got.a == hashlib.sha256(b"s||3|").hexdigest()
    assert got.b == hashlib.sha256(b"s|3").hexdigest()
    text = one(spark, a=X.stable_id("é|x", "y")).a
    assert text == hashlib.sha256("é|x|y".encode()).hexdigest()


@pytest.mark.parametrize(
    "heading, name",
    [("Table Name", "table_name"), ("  Is-Used? ", "is_used"), ("__A  b__", "a_b"), ("StartTime", "starttime")],
)
def test_canonical_name(spark, heading, name):
    assert X.canonical_name(heading) == name
    assert one(spark, a=X.canonical_text(F.lit(heading))).a == name


def test_numbers_from_text(spark):
    values = ["1,024.5 MB", "12kb", "1e5", "", None, "abc", " 7 ", "-3.9", "2 TB", "5 b", "1.", ".5", "9 pb", "1\n"]
    want = [1024.5 * 1024**2, 12 * 1024.0, None, None, None, None, 7.0, -3.9, 2 * 1024.0**4, 5.0, None, None, None, 1.0]
    assert over(spark, values, STRING, lambda c: V.as_number(c, STRING)) == want
    truncated = [None if w is None else int(w) for w in want]
    assert over(spark, values, STRING, lambda c: V.as_int(c, STRING)) == truncated


def test_numbers_from_doubles_drop_nan(spark):
    assert over(spark, [1.9, -1.9, float("nan"), None], DOUBLE, lambda c: V.as_int(c, DOUBLE)) == [1, -1, None, None]


def test_booleans(spark):
    values = ["Yes", " TRUE ", "1", "y", "0", "1.0", "no", "", None]
    got = over(spark, values, STRING, lambda c: V.as_bool(c, STRING, True))
    assert got == [True, True, True, True, False, False, False, False, True]
    assert over(spark, [True, False, None], T.BooleanType(), lambda c: V.as_bool(c, T.BooleanType())) == [
        True,
        False,
        False,
    ]


def test_timestamps_are_utc(spark):
    values = ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "2024-01-02T05:04:05+02:00", "1/2/2024 3:04:05 AM", "x", None]
    instant = datetime(2024, 1, 2, 3, 4, 5)
    got = over(spark, values, STRING, lambda c: V.as_timestamp(c, STRING).cast("string"))
    assert got == [str(instant)] * 4 + [None, None]


def test_duration(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    got = one(
        spark,
        a=V.duration_seconds(at("2024-01-01 00:00:00"), at("2024-01-01 00:00:01.5")),
        b=V.duration_seconds(at("2024-01-02"), at("2024-01-01")),
        c=V.duration_seconds(at(None), at("2024-01-01")),
    )
    assert (got.a, got.b, got.c) == (1.5, 0.0, None)


def test_ranks(spark):
    labels = ["critical", "ERROR", "High", "WARNING", "medium", "INFO", "low", "bogus", "", None]
    assert over(spark, labels, STRING, V.severity_rank) == [5, 4, 4, 3, 3, 2, 1, 0, 0, 0]
    assert over(spark, ["high", "Medium", "LOW", "x", None], STRING, V.risk_rank) == [3, 2, 1, 0, 0]
    assert over(spark, ["high", "Critical", "error", "WARNING", None], STRING, V.is_high_severity) == [
        True,
        True,
        True,
        False,
        False,
    ]


def test_two_decimals_are_rounded_from_the_binary_value(spark):
    rng = random.Random(7)
    values = [0.125, 0.375, 1.005, 1.015, 2.675, 0.0, 99.995, 100.0, 0.005, 0.015, 1e7 + 0.125]
    values += [rng.random() * 10 ** rng.randint(-3, 6) for _ in range(3000)]
    values += [n / 200 for n in range(1, 4000, 2)]
    assert over(spark, values, DOUBLE, V.fixed2) == [f"{v:.2f}" for v in values]


def test_error_categories_in_order(spark):
    cases = {
        "HTTP 401": ("AUTHENTICATION", False),
        "403 needs permission": ("AUTHORIZATION", False),
        "unauthorized 429": ("AUTHENTICATION", False),
        "request was Throttled": ("THROTTLING", True),
        "Operation TIMED OUT": ("TIMEOUT", True),
        "item doesn't exist": ("NOT_FOUND", False),
        "boom 503": ("ANALYSIS_ERROR", True),
        "boom": ("ANALYSIS_ERROR", False),
    }
    assert over(spark, list(cases), STRING, M.error_category) == [c for c, _ in cases.values()]
    assert over(spark, list(cases), STRING, M.is_retryable) == [r for _, r in cases.values()]


def test_error_text_is_kept_whole(spark):
    got = over(spark, ["x" * 5000], STRING, lambda c: X.error_text(F.lit("ValueError"), c))
    assert got == ["ValueError: " + "x" * 5000]


def test_guids(spark):
    guid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    spellings = [guid.upper(), "{" + guid + "}", guid.replace("-", ""), "urn:uuid:" + guid, "no", "", None]
    assert over(spark, spellings, STRING, X.normalized_guid) == [guid] * 4 + [None] * 3
    assert str(uuid.UUID(spellings[3])) == guid
    text = f'{{"id": "{guid.upper()}", "other": ["x{guid}y"]}}'
    assert over(spark, [text, None], STRING, lambda c: X.guids_in(c)) == [[guid, guid], []]
    listed = f" {guid};{guid.upper()},\n bad"
    assert over(spark, [listed, ""], STRING, X.guid_list) == [[guid, None], []]


def test_upns(spark):
    assert over(spark, [" B@x.com;a@x.com,b@X.com\n", ""], STRING, X.upn_list) == [["a@x.com", "b@x.com"], []]
    assert over(spark, [" A@x ", "  ", None], STRING, X.normalized_requester) == ["a@x", None, None]


def test_fallback_reasons(spark):
    reasons = ["None", "n/a", " No Fallback ", "", "  ", None, "View"]
    assert over(spark, reasons, STRING, M.is_fallback) == [False, False, False, False, True, False, True]


def test_storage_texts(spark):
    got = one(
        spark,
        a=M.storage_evidence(F.lit(52428800 + 5243), F.lit(12.345), F.lit(1234567)),
        b=M.storage_evidence(F.lit(52428800), F.lit(None).cast("double"), F.lit(None).cast("bigint")),
    )
    assert got.a == f"Column size={(52428800 + 5243) / 1048576:.2f} MB; model share={12.345:.2f}%; cardinality=1,234,567"
    assert got.b == "Column size=50.00 MB"
    kinds = over(spark, ["DateTime", "timestamp date", "String", "rich TEXT", "int64", None], STRING, M.storage_advice)
    tails = [M.ADVICE_DATETIME] * 2 + [M.ADVICE_TEXT] * 2 + [M.ADVICE_OTHER] * 2
    assert kinds == [f"{M.CONFIRM_USE} {t}" for t in tails]
    assert over(spark, ["DirectLake", "Import, Direct Lake", "Import"], STRING, M.is_direct_lake) == [True, True, False]


def test_json_of_a_row(spark):
    df = spark.createDataFrame(
        [(2, None, "é", datetime(2024, 1, 2, tzinfo=timezone.utc))], "b int, `A x` string, c string, t timestamp"
    ).select(F.struct("b", "A x", "c", "t").alias("raw"))
    got = df.select(X.json_text(df, "raw").alias("j")).first().j
    assert got == '{"A x":null,"b":2,"c":"é","t":"2024-01-02T00:00:00+00:00"}'


def test_availability_notes(spark):
    s, n = F.lit, F.lit
    got = one(
        spark,
        a=M.availability_note(s("NOT_RUN"), n(0), s("NOT_RUN"), n(0), s("NOT_APPLICABLE"), n(0), s("SUCCEEDED"), n(0)),
        b=M.availability_note(s("SUCCEEDED"), n(2), s("FAILED"), n(0), s("SUCCEEDED"), n(1), s("SUCCEEDED"), n(9)),
        c=M.availability_note(s("SUCCEEDED"), n(0), s("SUCCEEDED"), n(0), s("SUCCEEDED"), n(0), s("NOT_RUN"), n(0)),
    )
    assert got.a == " ".join([M.NOTE_REFRESH_NOT_RUN, M.NOTE_USAGE_NOT_RUN, M.NOTE_DIRECT_LAKE_NA, M.NOTE_ACCESS_EMPTY])
    assert got.b == M.NOTE_DEFAULT
    assert got.c == " ".join([M.NOTE_REFRESH_EMPTY, M.NOTE_USAGE_EMPTY, M.NOTE_DIRECT_LAKE_EMPTY])
    assert re.match("All requested", got.b)
