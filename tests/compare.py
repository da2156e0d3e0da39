"""Run registered queries in Spark and their SQL in DuckDB, and compare the sorted rows.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return repr(float(value)) if isinstance(value, float) else str(value)


# Spark type -> DuckDB type.
TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


# No Python in the plans, no cross joins.
UNWANTED = ["Python", "ArrowEval", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"]


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark, folder, name, queries, oracles, con) -> str:
    """'' when equal, else what differs."""
    df = queries[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    unwanted = [n for n in UNWANTED if n in plan]
    if unwanted:
        return f"plan has {unwanted}"
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(oracles[name])
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))}"
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    other = {n: (t, kinds[n]) for n, t in df.dtypes if TYPES.get(t, t) != kinds[n]}
    if other:
        return f"types {other}"
    if got == want:
        return ""
    extra, missing = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
    return f"{len(got)} rows against {len(want)}\n  spark {extra[:2]}\n  sql   {missing[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder, chosen = sys.argv[1], sys.argv[2:]
    queries, oracles, con = entry.queries(), entry.oracle_sql(), connect(folder)
    print("without SQL:", sorted(set(queries) - set(oracles)), "unknown:", sorted(set(oracles) - set(queries)))
    for name in chosen or queries:
        started = time.time()
        try:
            found = difference(spark, folder, name, queries, oracles, con) if name in oracles else "no SQL"
        except Exception as exc:  # report and go on
            found = f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{'ok  ' if not found else 'DIFF'} {name} {time.time() - started:.1f}s {found}", flush=True)
