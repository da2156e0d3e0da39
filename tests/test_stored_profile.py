import random

import pytest

from modelsift.operators import profile
from modelsift.session import shared_folder
from modelsift.sinks.profiles import ProfileStore

SCHEMA = "k bigint, t string, d double, empty string, v array<float>, odd struct<a: int>"


def rows(first, n, seed=3):
    rng = random.Random(seed + first)
    return [
        (i, rng.choice(["a", "bb", "é", None]), rng.choice([0.0, -0.0, 1.5, None]), None, [float(i % 7), 1.0], (1,))
        for i in range(first, first + n)
    ]


def shown(df):
    return {r.column_name: (r.row_count, r.null_count, r.cardinality, r.dictionary_size_bytes) for r in df.collect()}


def test_parts_add_up_to_the_whole(spark):
    store = ProfileStore(spark, f"{shared_folder(spark)}/profile-test-a")
    parts = [rows(0, 3000), rows(3000, 500), rows(2000, 1500)]  # the last overlaps both
    for i, part in enumerate(parts):
        store.add("tab", f"p{i}", spark.createDataFrame(part, SCHEMA))
    whole = spark.createDataFrame(sum(parts, []), SCHEMA)
    exact, got = shown(profile.column_profile({"tab": whole}, "m")), shown(store.profile("m"))
    assert set(got) == set(exact) == {"k", "t", "d", "empty", "v"}
    for name, (n, nulls, distinct, _) in exact.items():
        assert got[name][:2] == (n, nulls)
        assert abs(got[name][2] - distinct) <= 0.03 * distinct, name
    assert (got["t"][2], got["d"][2], got["empty"][2], got["v"][2]) == (3, 2, 0, 7)
    assert got["v"][3] == 7 * 8 and got["empty"][3] == 0


def test_a_part_added_again_or_dropped(spark):
    store = ProfileStore(spark, f"{shared_folder(spark)}/profile-test-b")
    df = spark.createDataFrame(rows(0, 100), SCHEMA)
    store.add("tab", "day-1", df)
    store.add("tab", "day-1", df)
    store.add("tab", "day-2", df.filter("k < 10"))
    store.add("other", "day-1", df.limit(0))
    assert {v[0] for v in shown(store.profile("m", ["tab"])).values()} == {110}
    assert set(shown(store.profile("m", ["other"])).values()) == {(0, 0, 0, 0)}
    store.drop("tab", "day-2")
    got = store.profile("m", ["tab"])
    assert shown(got)["k"][:2] == (100, 0) and got.columns == profile.column_profile({"tab": df}, "m").columns
    with pytest.raises(ValueError):
        store.add("tab", "../x", df)


def test_a_column_that_changes_its_type(spark):
    store = ProfileStore(spark, f"{shared_folder(spark)}/profile-test-c")
    store.add("tab", "a", spark.sql("select 1 as x"))
    store.add("tab", "b", spark.sql("select 'text' as x, 2 as y"))
    got = {(r.column_name, r.data_type): r.row_count for r in store.profile("m").collect()}
    assert got == {("x", "int"): 1, ("x", "string"): 1, ("y", "int"): 1}
