import random
from collections import defaultdict

from pyspark.sql import functions as F

from modelsift.operators.evidence import refresh_rows
from modelsift.operators.ranking import first_per_key, full_row_order, position_in_group, top_per_group
from modelsift.sources.landing import RAW
from modelsift.sources.testdata import scan_config


def skewed(seed, n=4000):
    """A third and more of all rows belong to one group."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 20)}", i, rng.randint(0, 50)) for i in range(n)]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_top_per_group_matches_sorting(spark):
    rows = skewed(1)
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(8)
    got = top_per_group(df, ["g"], [F.desc("v"), F.col("i")], 5)
    groups = defaultdict(list)
    for g, i, v in rows:
        groups[g].append((-v, i))
    want = {(g, i, r + 1) for g, rs in groups.items() for r, (_, i) in enumerate(sorted(rs)[:5])}
    assert {(r.g, r.i, r["rank"]) for r in got.collect()} == want
    # Groups are cut on the map side.
    assert "row_number(), 5, Partial" in plan_of(got)


def test_first_per_key_is_deterministic(spark):
    df = spark.createDataFrame([("a", None, "z"), ("a", 1, "b"), ("a", 1, "a"), ("b", 2, "q")], "k string, n int, t string")
    got = first_per_key(df, ["k"], full_row_order(df)).collect()
    assert sorted((r.k, r.n, r.t) for r in got) == [("a", None, "z"), ("b", 2, "q")]


def test_positions_match_enumeration(spark):
    rows = skewed(2)
    random.Random(3).shuffle(rows)
    ordinals = {i: i * 7 % 4001 for _, i, _ in rows}
    df = spark.createDataFrame([(g, ordinals[i], i) for g, i, _ in rows], "g string, o bigint, i int")
    # A span far below the group size: every group crosses many ranges.
    got = position_in_group(df, "g", "o", [F.col("i")], span=16)
    groups = defaultdict(list)
    for g, i, _ in rows:
        groups[g].append((ordinals[i], i))
    want = {(g, i, p) for g, rs in groups.items() for p, (_, i) in enumerate(sorted(rs))}
    assert {(r.g, r.i, r.position) for r in got.collect()} == want
    # No window runs over a whole group of rows.
    assert "windowspecdefinition(g#" in plan_of(got) and ", _range#" in plan_of(got)

def test_all_refreshes_keep_the_positions_of_the_latest(spark):
    """Without k no refresh is cut; positions, in the ids of rows without a request, are those of the ranking."""
    times = ["2024-01-01 10:00:00.5", "2024-01-01 10:00:00.25", "2024-01-03 00:00:00", None, "1969-01-01 00:00:00", None]
    rows = [("w", m, None, t, i, f"{m}{i}") for m in "ab" for i, t in enumerate(times * 5)]
    schema = f"workspace_id string, model_id string, request_id string, start string, source_ordinal bigint, {RAW} string"
    df = spark.createDataFrame(rows, schema).select(
        "workspace_id", "model_id", "request_id", F.col("start").cast("timestamp").alias("start_time"),
        F.lit(None).cast("timestamp").alias("end_time"), F.lit("Full").alias("refresh_type"),
        F.lit("Completed").alias("status"), "source_ordinal", F.struct(RAW).alias(RAW),
    )
    read = lambda k: {(r.refresh_id, r.raw_json) for r in refresh_rows(df, scan_config(), k).collect()}
    everything = read(None)
    assert len(everything) == len(rows)
    assert everything == read(1000)
    assert read(3) < everything and len(read(3)) == 6
