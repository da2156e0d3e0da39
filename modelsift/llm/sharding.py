"""Sharding along a Hilbert curve over several metadata columns.

Each dimension is quantised to 2 ** bits cells that hold about the same number of rows: the running total
of rows over its sorted distinct values gives every value its cell. The cells are coordinates of a point;
its index on the Hilbert curve sorts the rows so that a run of them stays small in every dimension at once.
Shard s of n is the s-th run of rows, so shards' counts differ by one at most, and the minimum and maximum
of each dimension per shard let a reader skip files. Law `rows`.

Null is a value of its own in a dimension, the lowest. Ties on the curve are ordered by the text's crc32,
the id (null first) and the size, so equal texts with equal metadata lie side by side. Rows that repeat an
id are rows of their own. An empty table gives no rows. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.llm.common import OWN, ranked, table
from modelsift.session import written

SHARDS = 16
DIMENSIONS = ("lang", "source", "n_chars")
BITS = 5


def cells(df: DataFrame, column: str, bits: int, total: int) -> DataFrame:
    """(value, cell) of every distinct value of a column."""
    value = f"{OWN}v_{column}"
    counts = df.groupBy(F.col(column).alias(value)).agg(F.count(F.lit(1)).alias(OWN + "rows"))
    runs = ranked(counts, [F.asc_nulls_first(value)], f"cells-{column}", OWN + "rows")
    cell = F.floor(F.col(OWN + "before") * (1 << bits) / total).cast("long")
    return runs.select(value, cell.alias(f"{OWN}x_{column}"))


def hilbert_index(df: DataFrame, axes: list[str], bits: int, to: str) -> DataFrame:
    """Adds the index on the curve of the point in the columns axes (Skilling's transform, bit by bit)."""
    x = [F.col(a) for a in axes]
    extra: list[str] = []

    def put(**values: Column) -> None:
        nonlocal df
        df = df.withColumns(values)

    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i, axis in enumerate(axes):
            inverts = x[i].bitwiseAND(q) != 0
            swapped = x[0].bitwiseXOR(x[i]).bitwiseAND(p)
            if i == 0:
                put(**{axis: F.when(inverts, x[0].bitwiseXOR(F.lit(p))).otherwise(x[0])})
            else:
                put(
                    **{
                        axes[0]: F.when(inverts, x[0].bitwiseXOR(F.lit(p))).otherwise(x[0].bitwiseXOR(swapped)),
                        axis: F.when(inverts, x[i]).otherwise(x[i].bitwiseXOR(swapped)),
                    }
                )
        q >>= 1
    for i in range(1, len(axes)):
        put(**{axes[i]: x[i].bitwiseXOR(x[i - 1])})
    flip = f"{to}_flip"
    extra.append(flip)
    q, flips = 1 << (bits - 1), F.lit(0).cast("long")
    while q > 1:
        flips = flips.bitwiseXOR(F.when(x[-1].bitwiseAND(q) != 0, F.lit(q - 1).cast("long")).otherwise(F.lit(0)))
        q >>= 1
    put(**{flip: flips})
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            bit = F.shiftright(F.col(axis).bitwiseXOR(F.col(flip)), b).bitwiseAND(1)
            index = index * 2 + bit
    return df.withColumn(to, index).drop(*extra)


def hilbert_shards(docs: DataFrame, dimensions=DIMENSIONS, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) of every row of docs; size is the text's bytes plus 1."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = written(
        docs.select(
            "doc_id",
            (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            *[F.col(c).alias(f"{OWN}d_{c}") for c in dimensions],
        ),
        "shard-sizes",
    )
    total = narrow.count()
    placed = narrow
    for c in dimensions:
        at = cells(narrow.withColumnRenamed(f"{OWN}d_{c}", c), c, bits, max(total, 1))
        placed = placed.join(at, F.col(f"{OWN}d_{c}").eqNullSafe(F.col(f"{OWN}v_{c}"))).drop(
            f"{OWN}v_{c}", f"{OWN}d_{c}"
        )
    axes = [f"{OWN}x_{c}" for c in dimensions]
    curve = hilbert_index(placed, axes, bits, "curve").drop(*axes)
    order = [F.asc("curve"), F.asc("text_crc32"), F.asc_nulls_first("doc_id"), F.asc("size")]
    position = F.col(OWN + "position")
    shard = F.floor(position * shards / max(total, 1))
    first = F.ceil(shard * F.lit(total) / shards)
    return ranked(curve, order, "shard-order").select(
        "doc_id",
        "size",
        "text_crc32",
        "curve",
        shard.cast("int").alias("shard"),
        (position - first).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, **settings) -> DataFrame:
    """Write the documents by shard, in slot order, and return the plan that was used.

    Rows find their shard by id, so ids must be unique here.
    """
    plan = written(hilbert_shards(docs, **settings), "shard-plan")
    at = plan.select(F.col("doc_id").alias(OWN + "id"), "shard", "slot")
    rows = docs.join(at, F.col("doc_id").eqNullSafe(F.col(OWN + "id"))).drop(OWN + "id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(
        path
    )
    return plan


def op5_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert_shards(table(spark, folder, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _sql() -> str:
    """The same curve as DuckDB SQL, one CTE a step. DuckDB has no crc32: a table of 256 makes it."""
    names, bits = ["x0", "x1", "x2"], BITS
    steps, last = [], "p0"

    def step(**values: str) -> None:
        nonlocal last
        new = f"p{len(steps) + 1}"
        picks = ", ".join(f"{v} AS {k}" for k, v in values.items())
        steps.append(f"{new} AS (SELECT * REPLACE ({picks}) FROM {last})")
        last = new

    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i, n in enumerate(names):
            t = f"(xor(x0, {n}) & {p})"
            if i == 0:
                step(x0=f"CASE WHEN x0 & {q} <> 0 THEN xor(x0, {p}) ELSE x0 END")
            else:
                step(
                    **{
                        "x0": f"CASE WHEN {n} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, {t}) END",
                        n: f"CASE WHEN {n} & {q} <> 0 THEN {n} ELSE xor({n}, {t}) END",
                    }
                )
        q >>= 1
    step(x1="xor(x1, x0)")
    step(x2="xor(x2, x1)")
    flip = "0"
    q = 1 << (bits - 1)
    while q > 1:
        flip = f"xor({flip}, CASE WHEN x2 & {q} <> 0 THEN {q - 1} ELSE 0 END)"
        q >>= 1
    index = "0"
    for b in range(bits - 1, -1, -1):
        for n in names:
            index = f"({index}) * 2 + ((xor({n}, f) >> {b}) & 1)"
    cell = ", ".join(
        f"c{i} AS (SELECT {c} AS v, floor(coalesce(sum(count(*)) OVER (ORDER BY {c} NULLS FIRST ROWS BETWEEN "
        f"UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << bits} / (SELECT count(*) FROM documents))::BIGINT AS x "
        f"FROM documents GROUP BY {c})"
        for i, c in enumerate(DIMENSIONS)
    )
    joins = " ".join(f"JOIN c{i} ON d.{c} IS NOT DISTINCT FROM c{i}.v" for i, c in enumerate(DIMENSIONS))
    rounds = "SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN " \
        "xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM g WHERE k < 8"
    return f"""
WITH RECURSIVE g AS ({rounds}),
crc AS (SELECT list(c ORDER BY i) AS t FROM g WHERE k = 8),
d AS (
  SELECT doc_id, lang, source, n_chars, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
         xor(list_reduce(list_prepend(4294967295::UBIGINT,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT)),
             lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM documents, crc),
{cell},
p0 AS (SELECT d.doc_id, d.size, d.text_crc32, c0.x AS x0, c1.x AS x1, c2.x AS x2 FROM d {joins}),
{", ".join(steps)},
f AS (SELECT *, {flip} AS f FROM {last}),
h AS (SELECT doc_id, size, text_crc32, {index} AS curve FROM f),
o AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST, size) - 1 AS n,
             count(*) OVER () AS total FROM h)
SELECT doc_id, size, text_crc32, 'rows' AS law, (n * {SHARDS} // total)::INT AS shard,
       (n - ceil((n * {SHARDS} // total) * total / {SHARDS}))::BIGINT AS slot, NULL::INT AS grown_shard
FROM o
"""


SQL = _sql()
