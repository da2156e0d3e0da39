"""Top-k, latest-row, position and repeated-key operators that stay balanced when one group is huge; unions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modelsift.session import written

POSITION_RANGE = 1_000_000
BROADCAST_HASHES = 1_000_000


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union of many frames, pairwise, so that no plan is analyzed once per frame."""
    while len(frames) > 1:
        pairs = [frames[i : i + 2] for i in range(0, len(frames), 2)]
        frames = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return frames[0]


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1.

    Filtering row_number() by a constant lets Spark cut every group to k rows on the map side, so
    the shuffle carries at most k rows per group and task whatever the group's size.
    """
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_first").drop("_first")


def full_row_order(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_first() for c in df.columns]


def position_in_group(
    df: DataFrame, key: str, ordinal: str, ties: list[Column], name: str = "position", span: int = POSITION_RANGE
) -> DataFrame:
    """Zero-based position of each row in its group, by an ordinal that is unique in the group.

    One window per group would put a third of all rows in one task. Rows are numbered inside
    ordinal ranges instead, and each range is shifted by the number of rows in the ranges before it;
    only the range counts are windowed per group. A range holds at most span rows of a group.
    """
    ranged = df.withColumn("_range", F.floor(F.coalesce(F.col(ordinal), F.lit(0)) / span))
    counts = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(key, "_range").orderBy(F.col(ordinal).asc_nulls_first(), *ties)
    return (
        ranged.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets, [key, "_range"])
        .withColumn(name, F.col("_before") + F.col("_at"))
        .drop("_range", "_before", "_at")
    )


def key_hashes(df: DataFrame, keys: list[str]) -> tuple[int, DataFrame]:
    """How many rows have a hash of their key to themselves, and the hashes (key_hash) that several rows share.

    Only hashes are shuffled. A row alone with its hash is alone with its key; whether rows that share a hash share
    the key is seen from the keys themselves.
    """
    rows = df.select(F.xxhash64(*keys).alias("key_hash")).groupBy("key_hash").agg(F.count(F.lit(1)).alias("n"))
    shared = F.when(F.col("n") > 1, F.col("key_hash"))
    found = written(rows.groupBy(shared.alias("key_hash")).agg(F.count(F.lit(1)).alias("n")), "key-hashes")
    alone = found.filter(F.col("key_hash").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return alone, found.filter(F.col("key_hash").isNotNull()).select("key_hash")


def by_key_hash(df: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame | None, int]:
    """(rows that are alone with their key, the other rows, number of the former); None for a part that is not needed.

    For keys as wide as ids, most of which occur once: only rows of repeated hashes are left to be grouped by key. Where
    these hashes are too many to broadcast, all rows are.
    """
    alone, hashes = key_hashes(df, keys)
    repeated = hashes.count()
    if repeated == 0:
        return df, None, alone
    if repeated > BROADCAST_HASHES:
        return None, df, 0
    hashed, hashes = df.withColumn("key_hash", F.xxhash64(*keys)), F.broadcast(hashes)
    # Not as semi and anti joins: Spark moves these below the key's own computation and computes the key twice.
    others = hashed.join(hashes.withColumn("_shared", F.lit(True)), "key_hash", "left").filter(F.col("_shared").isNull())
    return others.drop("key_hash", "_shared"), hashed.join(hashes, "key_hash").drop("key_hash"), alone
