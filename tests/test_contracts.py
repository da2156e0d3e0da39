from pyspark.sql import types as T

from modelsift.operators import contracts

DDL = T.StructType.fromDDL


def checked(df, schema):
    table = contracts.contract_table(df.sparkSession, contracts.contract_rows(1, {"x": schema}))
    return {r.column_path: (r.status, r.reason, r.null_values) for r in contracts.contract_check({"x": df}, table).collect()}


def test_types_that_hold_all_values_are_widened(spark):
    df = spark.sql(
        "select 1Y t, 1 i, 2L l, cast(1 as float) f, 1D d, date'2024-01-01' day, 1.25 as m, 'a' s, true b from range(3)"
    )
    got = checked(df, DDL("t int, i bigint, l int, f double, d float, day timestamp_ntz, m decimal(5,3), s int, b boolean"))
    assert {k: v[0] for k, v in got.items()} == {
        "t": "WIDENED", "i": "WIDENED", "l": "BROKEN", "f": "WIDENED", "d": "BROKEN", "day": "WIDENED", "m": "WIDENED", "s": "BROKEN", "b": "OK",
    }
    assert not contracts.fits("int", "float") and not contracts.fits("bigint", "double")
    assert contracts.fits("int", "decimal(10,0)") and not contracts.fits("int", "decimal(10,1)")


def test_nested_places_and_their_nulls(spark):
    rows = [
        ((1, None), [(1,), None, (None,)], {"a": None, "b": 2}),
        (None, None, None),
        ((None, "x"), [], {}),
    ]
    df = spark.createDataFrame(rows, "S struct<A: int, b: string>, l array<struct<n: int>>, m map<string, int>")
    need = lambda t, null: T.StructField("n", t, null)
    schema = T.StructType(
        [
            T.StructField("s", T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("B", T.StringType(), False)]), False),
            T.StructField("l", T.ArrayType(T.StructType([need(T.LongType(), False)]), False), True),
            T.StructField("m", T.MapType(T.StringType(), T.IntegerType(), False), True),
        ]
    )
    assert checked(df, schema) == {
        "s": ("BROKEN", "nulls", 1),
        "s.a": ("BROKEN", "nulls", 1),
        "s.b": ("BROKEN", "nulls", 1),
        "l": ("OK", "", 0),
        "l.element": ("BROKEN", "nulls", 1),
        "l.element.n": ("BROKEN", "nulls", 1),
        "m": ("OK", "", 0),
        "m.key": ("OK", "", 0),
        "m.value": ("BROKEN", "nulls", 1),
    }


def test_absent_missing_undeclared_and_empty(spark):
    df = spark.createDataFrame([], "a int, `odd name` string")
    got = checked(df, DDL("A int not null, b string, c string not null"))
    assert got == {
        "a": ("OK", "", 0), "odd name": ("OK", "undeclared", 0), "b": ("OK", "absent", 0), "c": ("BROKEN", "missing", 0),
    }


def test_versions(spark):
    old, new = DDL("a int, b int, c string, d bigint"), DDL("a bigint, b int not null, d int, e string, f int not null")
    rows = contracts.contract_rows(1, {"x": old}) + contracts.contract_rows(2, {"x": new})
    table = contracts.contract_table(spark, rows)
    df = spark.createDataFrame([(1, 1, "c", 2)], old)
    status = lambda version: {
        r.column_path: r.status for r in contracts.contract_check({"x": df}, table, version).collect()
    }
    assert set(status(1).values()) == {"OK"}
    assert status(2) == status(None) == {"a": "WIDENED", "b": "OK", "c": "OK", "d": "BROKEN", "e": "OK", "f": "BROKEN"}
    assert contracts.contract_changes(old, new) == {
        "a": ("WIDENED", "narrower"), "b": ("BROKEN", "required"), "c": ("OK", "undeclared"),
        "d": ("BROKEN", "type"), "e": ("OK", "absent"), "f": ("BROKEN", "missing"),
    }
    other = contracts.contract_check({"y": df}, table).collect()
    assert {(r.contract_version, r.reason) for r in other} == {(0, "undeclared")}
