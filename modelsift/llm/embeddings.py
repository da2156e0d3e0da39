"""Embedding near-dedup: codes by iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation of the centred, decorrelated space is learned on at most SAMPLE_ROWS vectors (chosen by a hash of the id) so
that its signs quantise the vectors with little loss; every vector gets the signs as its code. The code, of as many bits
as the vector has numbers and 64 at most, is cut into TABLES substrings; two vectors are candidates when a substring is equal in some table, which finds all
pairs whose codes differ in fewer bits than there are tables, and most beyond. Candidates are compared as
original vectors in double precision, as blocks of a bucket in a matrix product. A pair that meets in several
tables counts in the first alone. A bucket of any size is split into blocks of about BLOCK rows, and each pair of blocks is a
group of its own: it returns one row per vector (its links and the smallest vector it hangs together with),
not its pairs.

Vectors that are null, zero, or hold null or non-finite numbers link with nothing, and so do vectors without
an id. Rows that repeat an id are one vector (the smallest). Vectors of different lengths do not link. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelsift.llm.common import components, table
from modelsift.session import written

COSINE = 0.9
SAMPLE_ROWS = 20_000
ITERATIONS = 50
TABLES = 8
BLOCK = 1024


def valid(column: str = "vec"):
    """Whether the vector can have a cosine."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are brought near 1 by powers of two first, so no square over- or underflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learned_rotation(x: np.ndarray, iterations: int = ITERATIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation) of iterative quantisation: alternate signs and the closest rotation to them."""
    dims = x.shape[1]
    unit = unit_rows(x)
    mean = unit.mean(axis=0) if len(unit) > 1 else np.zeros(dims)
    _, axes = np.linalg.eigh((unit - mean).T @ (unit - mean))
    axes = axes[:, ::-1][:, : min(dims, 64)]
    v = (unit - mean) @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(iterations):
        codes = np.where(v @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ v)
        rotation = (left @ right).T
    return mean, axes @ rotation


def _models(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """One rotation for each length of vector in the sample."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vec").toArrow()["vec"].to_pylist()
    by_length: dict[int, list] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    return {k: learned_rotation(np.array(v, np.float64)) for k, v in by_length.items()}


def matrix(vectors: pa.Array) -> np.ndarray:
    """Equally long lists as rows in double precision."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def coder(models: dict[int, tuple[np.ndarray, np.ndarray]]):
    def codes(vectors: pa.Array) -> pa.Array:
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros(len(vectors), np.uint64)
        for dims in np.unique(lengths):
            at = np.flatnonzero(lengths == dims)
            x = unit_rows(matrix(vectors.take(pa.array(at))))
            mean, rotation = models.get(int(dims)) or (np.zeros(dims), np.eye(dims)[:, : min(dims, 64)])
            bits = (x - mean) @ rotation >= 0
            out[at] = (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return pa.array(out.view(np.int64))

    return codes


def _spans(tables: int, bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each substring of a code; a code of fewer bits than tables leaves some of them empty."""
    return [(bits * t // tables, bits * (t + 1) // tables - bits * t // tables) for t in range(tables)]


def substrings(tables: int) -> Column:
    """Table and value of each substring of column code, which has as many bits as column vec has numbers, 64 at most."""
    bits = "least(size(vec), 64)"
    parts = []
    for t in range(tables):
        first, end = f"{bits} * {t} div {tables}", f"{bits} * {t + 1} div {tables}"
        value = f"shiftrightunsigned(code, int({first})) & (shiftleft(1L, int({end} - {first})) - 1)"
        parts.append(F.struct(F.lit(t).alias("at"), F.expr(value).alias("value"), F.expr(f"{end} > {first}").alias("used")))
    return F.filter(F.array(*parts), lambda s: s["used"])


def block_links(cosine: float, tables: int):
    """Links inside a block, or between two blocks, of one bucket of one table."""

    def found(group: pa.Table) -> pa.Table:
        at, i, j = (group[c][0].as_py() for c in ("at", "i", "j"))
        ids = group["id"].to_numpy()
        x = unit_rows(matrix(group["vec"]))
        spans = _spans(tables, min(x.shape[1], 64))
        codes, blocks = group["code"].to_numpy().view(np.uint64), group["block"].to_numpy()
        rows = np.flatnonzero(blocks == i)
        cols = rows if i == j else np.flatnonzero(blocks == j)
        hit = x[rows] @ x[cols].T >= cosine
        if i == j:
            np.fill_diagonal(hit, False)
        r, c = np.nonzero(hit)
        r, c = rows[r], cols[c]
        differ = codes[r] ^ codes[c]
        for first, bits in (s for s in spans[:at] if s[1]):  # met in an earlier table
            new = (differ >> np.uint64(first)) & np.uint64((1 << bits) - 1) != 0
            r, c, differ = r[new], c[new], differ[new]
        links = np.bincount(r, minlength=len(ids)) + (np.bincount(c, minlength=len(ids)) if i != j else 0)
        root = ids.copy()
        while len(r):
            least = root.copy()
            np.minimum.at(least, r, root[c])
            np.minimum.at(least, c, root[r])
            if (least == root).all():
                break
            root = least
        some = links > 0
        return pa.table({"id": ids[some], "links": links[some].astype(np.int64), "root": root[some]})

    return found


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector of vectors(vec_id, embedding)."""
    element = vectors.schema["embedding"].dataType.elementType
    kind = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    given = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast(kind).alias("vec"))
    nameless = given.filter("id is null").select("id")
    rows = written(given.filter("id is not null").groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    usable = rows.filter(valid())
    encode = F.arrow_udf(coder(_models(usable)), "bigint")
    coded = written(usable.withColumn("code", encode("vec")), "vector-codes")
    entries = coded.select("id", "vec", "code", F.size("vec").alias("dims"), F.explode(substrings(tables)).alias("s"))
    entries = entries.select("id", "vec", "code", "dims", "s.at", "s.value")
    slim = coded.select(F.size("vec").alias("dims"), F.explode(substrings(tables)).alias("s"))
    sizes = slim.select("dims", "s.*").groupBy("dims", "at", "value").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("id", "at"), F.col("blocks")).cast("int")
    blocks = entries.join(sizes, ["dims", "at", "value"]).withColumn("block", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    groups = (
        blocks.withColumn("other", other)
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .select("dims", "at", "value", "i", "j", "block", "id", "code", "vec")
    )
    found = written(
        groups.groupBy("dims", "at", "value", "i", "j").applyInArrow(
            block_links(cosine, tables), "id bigint, links bigint, root bigint"
        ),
        "vector-links",
    )
    counts = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    hang = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct(), "vectors")
    all_rows = rows.select("id").unionByName(nameless)
    return (
        all_rows.join(counts, "id", "left")
        .join(hang, "id", "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def op8_itq_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))
