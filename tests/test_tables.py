from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelsift.config import ScanConfig
from modelsift.operators import merge
from modelsift.sinks.current import CurrentState
from modelsift.sinks.tables import TableSpec, Tables

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
HISTORY = T.StructType().add("id", "string").add("scan_id", "string").add("v", "integer")
STATE = T.StructType().add("semantic_model_id", "string").add("v", "integer")


@pytest.fixture
def tables(spark, request):
    name = "t_" + "".join(c if c.isalnum() else "_" for c in request.node.name)[:40]
    tables = Tables(spark)
    tables.ensure_schema(name)
    tables.name = name
    return tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_touches_only_its_scan(spark, tables):
    spec = TableSpec(f"{tables.name}.history", HISTORY)
    tables.ensure(spec, evolve=True)
    frame = lambda rs: spark.createDataFrame(rs, HISTORY)
    tables.upsert(spec, ["id"], frame([("a", "s1", 1), ("b", "s1", 2)]), "s1")
    files = set(spark.table(spec.name).inputFiles())
    tables.upsert(spec, ["id"], frame([("c", "s2", 3), ("c", "s2", 4)]), "s2")  # both rows of a key
    assert rows(tables.rows(spec)) == [("a", "s1", 1), ("b", "s1", 2), ("c", "s2", 3), ("c", "s2", 4)]
    tables.upsert(spec, ["id"], frame([("c", "s2", 9), ("d", "s2", 5)]), "s2")
    tables.upsert(spec, ["id"], frame([]), "s2")
    want = [("a", "s1", 1), ("b", "s1", 2), ("c", "s2", 9), ("d", "s2", 5)]
    assert rows(tables.rows(spec)) == want
    assert files <= set(spark.table(spec.name).inputFiles())  # the first scan's files were not rewritten
    tables.upsert(spec, ["id"], tables.rows(spec).filter("scan_id = 's2'"), "s2")  # replay
    assert rows(tables.rows(spec)) == want


@pytest.mark.parametrize("scan_id", ["2024-02-01T00:00:00Z", "a/b c", "50%", "it's", 'q"=\\x', "%3A", "ä{[]}#?*^"])
def test_scan_ids_of_any_characters(spark, tables, scan_id):
    spec = TableSpec(f"{tables.name}.odd_{abs(hash(scan_id))}", HISTORY)
    tables.ensure(spec, evolve=True)
    frame = lambda rs: spark.createDataFrame(rs, HISTORY)
    tables.upsert(spec, ["id"], frame([("a", "s", 0)]), "s")
    tables.upsert(spec, ["id"], frame([("a", scan_id, 1), ("b", scan_id, 2)]), scan_id)
    tables.upsert(spec, ["id"], frame([("b", scan_id, 3)]), scan_id)
    assert rows(tables.rows(spec)) == sorted([("a", "s", 0), ("a", scan_id, 1), ("b", scan_id, 3)])
    assert rows(tables.rows(spec).filter(F.col("scan_id") == scan_id)) == [("a", scan_id, 1), ("b", scan_id, 3)]


def test_rows_without_a_scan_are_refused(spark, tables):
    spec = TableSpec(f"{tables.name}.history", HISTORY)
    tables.ensure(spec, evolve=True)
    with pytest.raises(ValueError, match="without a scan_id"):
        tables.upsert(spec, ["id"], spark.createDataFrame([("a", None, 1)], HISTORY))
    assert rows(tables.rows(spec)) == []


def test_upsert_across_buckets(spark, tables):
    spec = TableSpec(f"{tables.name}.dim", T.StructType.fromDDL("model_id string, v int"), "model_id")
    tables.ensure(spec, evolve=True)
    first = [(f"m{i}", 0) for i in range(200)]
    tables.upsert(spec, ["model_id"], spark.createDataFrame(first, spec.schema))
    tables.upsert(spec, ["model_id"], spark.createDataFrame([(f"m{i}", 1) for i in range(150, 250)], spec.schema))
    assert rows(tables.rows(spec)) == sorted((f"m{i}", int(i >= 150)) for i in range(250))


LINKS = T.StructType().add("link", "string").add("semantic_model_id", "string")


@pytest.fixture
def current(spark, tables):
    names = {"state": f"{tables.name}.state", "links": f"{tables.name}.links"}
    state = CurrentState(spark, names, f"{tables.name}.pointer", {"state": STATE, "links": LINKS})
    state.ensure()
    state.ensure()
    return state


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "semantic_model_id string")


def publish(spark, current, state, links, done, analysis):
    frames = {"state": spark.createDataFrame(state, STATE), "links": spark.createDataFrame(links, LINKS)}
    return current.publish(frames, ids(spark, done), analysis)


def test_replacement_clears_empty_slices_and_keeps_others(spark, current):
    models = [f"m{i}" for i in range(100)]
    old = publish(spark, current, [(m, i) for m in models for i in range(3)], [("a", "m0"), ("b", "m2")], models, "one")
    files = set(spark.table(current.names["state"] + "_rows").inputFiles())
    # m0 gets new rows, m1 is processed without rows, the others are not processed.
    want = sorted([("m0", 7)] + [(m, i) for m in models[2:] for i in range(3)])
    for _ in range(2):
        publish(spark, current, [("m0", 7)], [("c", "m0")], ["m0", "m1", "m1"], "two")
        now = current.snapshot()
        assert rows(now["state"]) == want and rows(now["links"]) == [("b", "m2"), ("c", "m0")]
        assert rows(spark.table(current.names["state"])) == want
    assert files <= set(spark.table(current.names["state"] + "_rows").inputFiles())  # nothing was rewritten
    analyses = {r.semantic_model_id: r.analysis_id for r in now.pointers.collect()}
    assert analyses["m0"] == analyses["m1"] == "two" and analyses["m2"] == "one" and len(analyses) == 100
    # An earlier state stays readable in all tables until it is retired.
    then = current.snapshot(old)
    assert then["state"].count() == 300 and rows(then["links"]) == [("a", "m0"), ("b", "m2")]
    assert len(current.retire(keep=(old,))["state"]) == 1  # the publication that the replay replaced
    publish(spark, current, [], [], models, "three")
    assert rows(current.snapshot()["state"]) == [] == rows(current.snapshot()["links"])
    current.retire()
    assert spark.table(current.names["state"] + "_rows").isEmpty()


def test_a_failed_write_leaves_all_tables_as_they_were(spark, current):
    publish(spark, current, [("m", 1)], [("a", "m")], ["m"], "one")
    before = current.location()
    broken = ids(spark, ["m"]).select("semantic_model_id", F.raise_error(F.lit("stop")).cast("int").alias("v"))
    frames = {"links": spark.createDataFrame([("b", "m")], LINKS), "state": broken}
    with pytest.raises(Exception, match="stop"):
        current.publish(frames, ids(spark, ["m"]), "two")
    # One table was written, which nobody sees.
    assert current.location() == before
    assert rows(current.snapshot()["state"]) == [("m", 1)] and rows(current.snapshot()["links"]) == [("a", "m")]
    assert rows(spark.table(current.names["links"])) == [("a", "m")]


def test_two_runs_at_once_keep_each_others_models(spark, current, monkeypatch):
    frame = lambda rs: {"state": spark.createDataFrame(rs, STATE)}
    one, two = current.stage(frame([("m1", 1)])), current.stage(frame([("m2", 2)]))
    location, calls = CurrentState.location, []

    def other_switches_first(self):
        calls.append(1)
        if len(calls) == 2:  # between the first run's look at the pointer and its switch
            self.switch(ids(spark, ["m2"]), two, "two")
        return location(self)

    monkeypatch.setattr(CurrentState, "location", other_switches_first)
    current.switch(ids(spark, ["m1"]), one, "one")
    monkeypatch.undo()
    assert rows(current.snapshot()["state"]) == [("m1", 1), ("m2", 2)]


def test_only_named_partitions_are_read(spark, current):
    for i in range(4):
        publish(spark, current, [("m", i)], [], ["m"], f"run-{i}")
    df = current.snapshot()["state"]
    assert rows(df) == [("m", 3)]
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_added_and_never_dropped(spark, tables):
    old = TableSpec(f"{tables.name}.h", HISTORY)
    tables.ensure(old, evolve=True)
    tables.upsert(old, ["id"], spark.createDataFrame([("a", "s1", 1)], HISTORY), "s1")
    new = TableSpec(old.name, T.StructType.fromDDL("id string, scan_id string, V int, extra bigint"))
    tables.ensure(new, evolve=True)
    tables.ensure(new, evolve=True)
    assert set(spark.table(old.name).columns) == {"id", "scan_id", "v", "extra"}
    tables.upsert(new, ["id"], spark.createDataFrame([("b", "s1", 2, 5)], new.schema), "s1")
    assert rows(tables.rows(new)) == [("a", "s1", 1, None), ("b", "s1", 2, 5)]


def test_schema_names_are_checked(tables):
    with pytest.raises(ValueError, match="invalid"):
        tables.ensure_schema("a b; drop")


# ---- grants ----

ACCESS = (
    "access_key string, workspace_id string, model_id string, principal_upn string, source string, is_active boolean, "
    "valid_from timestamp, valid_to timestamp, updated_by string, updated_at timestamp"
)


def grant(spark, rs):
    old = NOW - timedelta(days=9)
    return spark.createDataFrame([(k, "w", m, u, s, a, old, None, "x", old) for k, m, u, s, a in rs], ACCESS)


def settings(**changes):
    return ScanConfig(scan_id="s", started_at=NOW, completed_at=NOW, requested_by="Me@x", **changes)


def test_grant_modes(spark):
    held = grant(
        spark,
        [
            ("1", "m1", "gone@x", merge.EXPLICIT_SOURCE, True),
            ("2", "m1", "manual@x", "MANUAL", True),
            ("3", "m1", "old@x", merge.EXPLICIT_SOURCE, False),
            ("4", "m2", "other@x", merge.EXPLICIT_SOURCE, True),
            ("5", "m3", "all@x", merge.EXPLICIT_SOURCE, True),
            ("6", "m3", None, merge.EXPLICIT_SOURCE, True),
            ("7", "m1", None, merge.EXPLICIT_SOURCE, True),
        ],
    )
    requests = spark.createDataFrame(
        [("w", "m1", ["new@x", "new@x"]), ("w", "m3", [])], "workspace_id string, model_id string, viewers array<string>"
    )
    active = lambda df: {(r.model_id, r.principal_upn): r.is_active for r in df.collect()}
    none = merge.synced_grants(held, requests, settings())
    assert none is held
    merged = active(merge.synced_grants(held, requests, settings(access_sync_mode="merge")))
    assert merged[("m1", "new@x")] and merged[("m1", "gone@x")] and len(merged) == 8
    result = merge.synced_grants(held, requests, settings(access_sync_mode="replace_scanner_managed"))
    got = active(result)
    assert got == {
        ("m1", "new@x"): True,
        ("m1", "gone@x"): False,
        ("m1", "manual@x"): True,
        ("m1", "old@x"): False,
        ("m1", None): True,  # NOT IN a list never holds for null
        ("m2", "other@x"): True,  # model not in the run
        ("m3", "all@x"): False,  # nobody asked for
        ("m3", None): False,
    }
    ended = {r.access_key: r.valid_to for r in result.collect() if r.access_key in "1357"}
    assert ended["1"] and ended["5"] and not ended["3"] and not ended["7"]


def test_viewer_parameter_becomes_requests(spark):
    targets = spark.createDataFrame(
        [("w", "m1", "PASSED"), ("w", "m2", "ERROR")], "workspace_id string, model_id string, permission_precheck_status string"
    )
    got = merge.viewer_requests(targets, settings(viewers="B@x a@x")).collect()
    assert [(r.model_id, list(r.viewers)) for r in got] == [("m1", ["a@x", "b@x"])]
    assert [list(r.viewers) for r in merge.viewer_requests(targets, settings()).collect()] == [[]]
