"""What the operators share: words in SQL, ranks over whole tables, connected components."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelsift.session import configure, written

# The words of a text, and what stands between them.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

# Own columns begin so; columns of the input that clash with them are not expected.
OWN = "__ms_"
ROWS_PER_PARTITION = 33  # bits that monotonically_increasing_id() keeps for the row


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per application; Spark serves the file to each of them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="modelsift-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Session defaults, with Arrow batches small enough for rows of long text."""
    configure(spark)
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of the whole text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from: crc32 of the id's text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def hash_sample(df: DataFrame, column: str, size: int) -> DataFrame:
    """At most size rows, by the hash of a column: a filter leaves about twice as many, a top-k takes the first.

    The filter follows the row count, so the top-k never has to sort more than a small multiple of size.
    """
    key = F.xxhash64(F.col(column).cast("string"))
    share = min(1.0, 2 * (size + 100) / max(df.count(), 1))
    return df.filter(F.pmod(key, F.lit(1 << 31)) < int(share * (1 << 31))).orderBy(key, column).limit(size)


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of all learnable rows, one per id."""
    learnable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return learnable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(text, label) of at most per_class learnable documents of each label, chosen by a hash of the id.

    The choice is made on the labels alone, so its at most 2 * per_class ids can be broadcast.
    """
    learnable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    learnable = learnable.select("doc_id", F.col(label).cast("int").alias(OWN + "label"))
    zeros, ones = (hash_sample(learnable.filter(F.col(OWN + "label") == v), "doc_id", per_class) for v in (0, 1))
    chosen = F.broadcast(zeros.unionByName(ones).groupBy("doc_id").agg(F.max(OWN + "label").alias(OWN + "label")))
    return documents.join(chosen, "doc_id").select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col(OWN + "label").alias("label")
    )


def ranked(df: DataFrame, order: Iterable[Column], name: str, weight: str | None = None) -> DataFrame:
    """df sorted as a whole, with __ms_position (from 0) and, with a weight, __ms_before (weights of all rows above).

    One range-partitioned sort is written; partitions then need only the totals of the partitions above
    them, a table of one row per partition. No task sees more than its own range.
    """
    pid, row, own, n_above, w_above = (f"{OWN}rank_{c}" for c in ("pid", "row", "own", "n", "w"))
    sorted_rows = written(
        df.orderBy(*order)
        .withColumn(pid, F.spark_partition_id())
        .withColumn(row, F.monotonically_increasing_id().bitwiseAND((1 << ROWS_PER_PARTITION) - 1)),
        name,
    )
    amount = F.coalesce(F.sum(weight), F.lit(0)) if weight else F.lit(0).cast("long")
    totals = sorted_rows.groupBy(pid).agg(F.count(F.lit(1)).alias("n"), amount.alias("w"))
    above = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(pid),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias(n_above),
        F.coalesce(F.sum("w").over(above), F.lit(0)).alias(w_above),
    )
    result = sorted_rows
    if weight:
        inside = Window.partitionBy(pid).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
        result = result.withColumn(own, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    result = result.join(F.broadcast(offsets), pid).withColumn(OWN + "position", F.col(row) + F.col(n_above))
    if weight:
        result = result.withColumn(OWN + "before", F.col(own) + F.col(w_above))
    return result.drop(pid, row, own, n_above, w_above)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) for every id in edges(a, b); component is the smallest id reachable.

    Ids are hashed, each node adopts its smallest neighbour or itself, and the edges are contracted, until
    none is left. In hashed order each round removes a constant share of the nodes, also on long chains.
    Groups shrink by partial aggregates, so a node with very many neighbours is no task of its own.
    """
    node = lambda c: F.xxhash64(F.col(c))
    both = edges.select("a", "b").filter("a <> b")
    links = written(both.select(node("a").alias("a"), node("b").alias("b")), f"{name}-links")
    ids = both.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = written(ids.select("id", node("id").alias("cur")), f"{name}-labels")
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(
            ends.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("n"), F.least("a", "p").alias("p")),
            f"{name}-parents",
        )
        labels = written(
            labels.join(parent, F.col("cur") == F.col("n"), "left").select(
                "id", F.coalesce("p", "cur").alias("cur")
            ),
            f"{name}-labels",
        )
        to = lambda c: parent.select(F.col("n").alias(c), F.col("p").alias(c + "p"))  # noqa: B023,E731
        links = written(
            links.join(to("a"), "a")
            .join(to("b"), "b")
            .select(F.least("ap", "bp").alias("a"), F.greatest("ap", "bp").alias("b"))
            .filter("a <> b")
            .distinct(),
            f"{name}-links",
        )
    smallest = labels.groupBy("cur").agg(F.min("id").alias("component"))
    return labels.join(smallest, "cur").select("id", "component")
