"""Operators that SQL can express, against DuckDB."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import compare
from conftest import SMALL
from modelsift.llm import mixing, quality_rules, sharding
from modelsift.llm.queries import ORACLES, QUERIES
from odd_rows import no_documents, odd_documents  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = compare.connect(SMALL)
    got = QUERIES[name](spark, SMALL)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert compare.rows_of(got.columns, got.collect()) == compare.rows_of(names, cursor.fetchall())


def over(documents, sql):
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pandas(documents.toPandas()[["doc_id", "text", "lang", "source", "n_chars"]].astype({"doc_id": "Int64", "n_chars": "Int64"})))
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return compare.rows_of(names, cursor.fetchall())


def test_rules_on_odd_rows(spark, odd_documents, no_documents):
    got = quality_rules.quality_verdicts(odd_documents.select("doc_id", "text")).drop("text")
    assert compare.rows_of(got.columns, got.collect()) == over(odd_documents, quality_rules.SQL)
    assert quality_rules.quality_verdicts(odd_documents).columns[: len(odd_documents.columns)] == odd_documents.columns
    assert quality_rules.quality_verdicts(no_documents).count() == 0


def test_native_plan_has_no_python(spark, odd_documents):
    plan = sharding.hilbert_shards(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in compare.UNWANTED[:3] if n in plan]


def test_mix_on_odd_rows(spark, odd_documents, no_documents):
    got = mixing.mixed_documents(odd_documents).select("doc_id", "size", "source_size", "target", "taken")
    assert compare.rows_of(got.columns, got.collect()) == over(odd_documents, mixing.SQL)
    rows = got.collect()
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    assert mixing.mixed_documents(no_documents).count() == 0
    copies = mixing.mixed_copies(odd_documents)
    assert copies.columns == odd_documents.columns


def test_shards_on_odd_rows(spark, odd_documents, no_documents):
    got = sharding.hilbert_shards(odd_documents, shards=4)
    rows = got.collect()
    assert len(rows) == odd_documents.count()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.hilbert_shards(no_documents).count() == 0


def test_curve_visits_every_cell_by_single_steps(spark):
    cells = spark.range(512).select(*[(F.col("id") / 8**i).cast("long").alias(f"a{i}") for i in range(3)])
    cells = cells.select(*[(F.col(f"a{i}") % 8).alias(f"a{i}") for i in range(3)])
    keep = cells.select("*", *[F.col(f"a{i}").alias(f"b{i}") for i in range(3)])
    path = sharding.hilbert_index(keep, ["a0", "a1", "a2"], 3, "at").orderBy("at").collect()
    assert [r["at"] for r in path] == list(range(512))
    steps = [sum(abs(p[f"b{i}"] - q[f"b{i}"]) for i in range(3)) for p, q in zip(path, path[1:], strict=False)]
    assert set(steps) == {1}
