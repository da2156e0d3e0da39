import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from modelsift.operators import checks, profile
from modelsift.operators.usage import unused_objects

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)


def brute(rows, index):
    values = [r[index] for r in rows]
    present = {v for v in values if v is not None}
    bits = (max(len(present), 2) - 1).bit_length()
    return len(values), len(values) - sum(v is not None for v in values), len(present), -(-len(values) * bits // 8)


def test_profile_matches_counting(spark):
    rng = random.Random(5)
    long_texts = ["x" * 500 + str(i) for i in range(20)]
    rows = [
        (
            i,
            "hot" if rng.random() < 0.4 else rng.choice(["a", "bb", "é", None]),
            rng.choice(long_texts),
            rng.choice([0.0, -0.0, 1.5, None]),
            None,
            7,
        )
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "k bigint, t string, long string, d double, empty string, same int")
    got = {r.column_name: r for r in profile.column_profile({"tab": df}, "m").collect()}
    for index, name in enumerate(df.columns):
        r = got[name]
        assert (r.row_count, r.null_count, r.cardinality, r.data_size_bytes) == brute(rows, index), name
    assert got["t"].dictionary_size_bytes == len("hot" + "a" + "bb" + "é") + 1
    assert got["long"].dictionary_size_bytes == sum(map(len, long_texts))
    assert got["d"].dictionary_size_bytes == len("0.0" + "1.5")
    assert got["empty"].dictionary_size_bytes == 0
    assert abs(sum(r.model_size_pct for r in got.values()) - 100) < 1e-9
    near = {r.column_name: r for r in profile.column_profile({"tab": df}, "m", approximate=True).collect()}
    for name, r in got.items():
        assert (near[name].row_count, near[name].null_count) == (r.row_count, r.null_count)
        assert abs(near[name].cardinality - r.cardinality) <= 0.1 * r.cardinality

    broken = {(r["Rule Name"], r["Object Name"]) for r in profile.rule_violations(
        profile.column_profile({"tab": df}, "m")).collect()}
    assert broken == {
        ("Constant column", "same"),
        ("Mostly empty column", "empty"),
        ("Wide text column", "long"),
    }


def test_unused_objects_window(spark):
    objects = spark.createDataFrame(
        [("m", "t", "Column", c) for c in "abc"], "model_id string, table_name string, object_type string, object_name string"
    )
    at = lambda days: NOW - timedelta(days=days)
    log = spark.createDataFrame(
        [("m", "t", "a", at(1))] * 500 + [("m", "t", "a", at(14)), ("m", "t", "b", at(14.1)), ("m", "t", "c", NOW)],
        "model_id string, table_name string, object_name string, ts timestamp",
    )
    got = {r.object_name: (r.is_used, r.usage_count) for r in unused_objects(objects, log, NOW, 14).collect()}
    assert got == {"a": (True, 501), "b": (False, 0), "c": (False, 0)}


def test_integrity_and_uniqueness(spark):
    child = spark.createDataFrame([(1,)] * 50 + [(2,), (9,), (9,), (None,)], "fk int")
    parent = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    got = checks.relationship_integrity({"c": child, "p": parent}, "c", "fk", "p", "id").first()
    assert (got.child_rows, got.orphan_rows, got.orphan_keys) == (53, 2, 1)
    got = checks.key_uniqueness("p", parent, ["id"]).first()
    assert (got.row_count, got.distinct_keys, got.duplicate_keys, got.surplus_rows) == (4, 3, 1, 1)
    empty = checks.key_uniqueness("p", parent.filter(F.lit(False)), ["id"]).first()
    assert (empty.row_count, empty.surplus_rows) == (0, 0)


def test_contract_reports_every_difference(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, "a", 2.0), (None, "b", 3.0)], "ID int, t string, extra double")
    declared = T.StructType.fromDDL("id int not null, t bigint, missing string")
    got = {r.column_name: (r.status, r.null_rows) for r in checks.schema_contract("x", df, declared).collect()}
    assert got == {"id": ("OK", 1), "t": ("TYPE", 0), "missing": ("MISSING", 0), "extra": ("EXTRA", 0)}
