"""Mixing sources to target weights by capped water-filling.

Every source wants its weight's share of the words to take and stops at a maximum of epochs; what it
cannot take is shared by weight among the others until none is above its maximum. With sources sorted
by (maximum / weight) the stopped ones are a prefix, so running totals give the water level exactly.

Each source's documents are then repeated: the whole epochs for all, the fractional one for the documents
whose middle lies below the wanted words in a seeded order of the source. A source misses its target by
half its longest document at most, a document is never taken oftener than the maximum, and reruns agree.

Null sources are a source of their own, the last. Null texts have size 0 and are taken 0 words; a source
without words has the target 0. Rows that repeat an id or have none are rows of their own, also when they are
copied. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.llm.common import OWN, ranked, table, word_count
from modelsift.session import written

WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating
SHARE = (3, 2)  # words to take over words there
EPOCHS = 2
SEED = "mix-1"


def by_source() -> list[Column]:
    """Code-point order, null last."""
    return [F.asc_nulls_last(OWN + "source")]


def seeded(column: str) -> Column:
    """A 60-bit number from the seed and an id."""
    text = F.concat(F.lit(SEED + ":"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, size, target, first) of each source; first: the sizes of the sources before it in code-point order.

    sized: (source, size) per document. Sizes are whole numbers, so sums are exact in any order.
    """
    source, size = OWN + "source", OWN + "size"
    sources = sized.groupBy(source).agg(F.sum(size).alias(OWN + "s"))
    named = ranked(sources, by_source(), "mix-sources", OWN + "s")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col(OWN + "position") % len(weights) + 1).cast("int"))
    named = named.select(
        source, F.col(OWN + "s"), F.col(OWN + "before").alias(OWN + "first"), pick.cast("long").alias(OWN + "w")
    )
    cap = F.col(OWN + "s") * epochs
    both = ranked(
        named.withColumn(OWN + "ratio", cap / F.col(OWN + "w")),
        [F.asc(OWN + "ratio"), *by_source()],
        "mix-level",
        OWN + "w",
    ).withColumnRenamed(OWN + "before", OWN + "w_before")
    both = ranked(
        both.drop(OWN + "position"), [F.asc(OWN + "ratio"), *by_source()], "mix-caps", OWN + "s"
    ).withColumnRenamed(OWN + "before", OWN + "s_before")
    totals = both.agg(F.sum(OWN + "s").alias(OWN + "all_s"), F.sum(OWN + "w").alias(OWN + "all_w"))
    # Level if this source and all after it were not stopped: what is left over the weights left.
    left = (F.col(OWN + "all_s") * share[0] - F.col(OWN + "s_before") * (epochs * share[1])).cast("double")
    both = both.crossJoin(F.broadcast(totals)).withColumn(
        OWN + "level", left / ((F.col(OWN + "all_w") - F.col(OWN + "w_before")) * share[1]).cast("double")
    )
    free = both.filter(F.col(OWN + "level") < F.col(OWN + "ratio"))
    level = free.agg(F.min_by(OWN + "level", OWN + "position").alias(OWN + "water"))
    both = both.crossJoin(F.broadcast(level))
    stopped = F.coalesce(F.col(OWN + "ratio") <= F.col(OWN + "water"), F.lit(True))
    target = F.when(stopped, cap.cast("double")).otherwise(F.col(OWN + "water") * F.col(OWN + "w"))
    return both.select(source, F.col(OWN + "s"), F.col(OWN + "first"), target.alias(OWN + "target"))


def mixed_documents(
    docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS, carried: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) of every row of docs(doc_id, text, source).

    carried: further columns of docs to return; they also order rows that are alike in source, id and size.
    """
    source, size, seed = OWN + "source", OWN + "size", OWN + "seed"
    narrow = written(
        docs.select(
            F.col("doc_id"),
            F.col("source").alias(source),
            word_count(F.col("text")).alias(size),
            seeded("doc_id").alias(seed),
            *carried,
        ),
        "mix-sizes",
    )
    targets = written(source_targets(narrow.select(source, size), weights, share, epochs), "mix-targets")
    order = [*by_source(), F.asc(seed), F.asc_nulls_last("doc_id"), F.asc(size), *carried]
    rows = ranked(narrow, order, "mix-order", size).withColumnRenamed(source, source + "2")
    rows = rows.join(targets, F.col(source + "2").eqNullSafe(F.col(source)))
    repeats = F.col(OWN + "target") / F.greatest(F.col(OWN + "s"), F.lit(1)).cast("double")
    rows = rows.withColumn(OWN + "whole", F.floor(repeats))
    wanted = F.col(OWN + "target") - F.col(OWN + "whole") * F.col(OWN + "s")
    before = F.col(OWN + "before") - F.col(OWN + "first")
    chosen = (before * 2 + F.col(size)).cast("double") <= wanted * 2
    times = F.when(F.col(size) == 0, F.lit(0)).otherwise(
        F.col(OWN + "whole") + F.when(chosen & (F.col(OWN + "whole") < epochs), 1).otherwise(0)
    )
    rows = rows.withColumn("times", times.cast("long"))
    return rows.select(
        "doc_id",
        F.col(source).alias("source"),
        F.col(size).alias("size"),
        F.col(OWN + "s").alias("source_size"),
        F.col(OWN + "target").alias("target"),
        "times",
        (F.col("times") * F.col(size)).alias("taken"),
        *carried,
    )


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_documents(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def _place(row: str) -> Column:
    """Where a row stands in its source's order, null ids last."""
    return F.struct(F.col(OWN + "seed"), F.col("doc_id").isNull(), F.col("doc_id"), F.col(OWN + "size"), F.col(row))


def source_cuts(docs: DataFrame, row: str) -> DataFrame:
    """Per source what its rows' times follow from: whole epochs, and the place up to which rows are taken once more.

    docs(doc_id, text, source, row); row is a hash of all columns, so rows in one place are alike. m of them lie
    at the cut and c of those are taken once more.
    """
    source, seed, whole = OWN + "source", OWN + "seed", OWN + "whole"
    plan = mixed_documents(docs, carried=(row,)).filter("size > 0")
    plan = plan.select(
        F.col("source").alias(source),
        F.floor(F.col("target") / F.greatest("source_size", F.lit(1)).cast("double")).alias(whole),
        seeded("doc_id").alias(seed),
        "doc_id",
        F.col("size").alias(OWN + "size"),
        row,
        "times",
    )
    plan = written(plan.select(source, whole, _place(row).alias(OWN + "place"), (F.col("times") - F.col(whole)).alias("more")), "mix-plan")
    last = F.max(F.when(F.col("more") > 0, F.col(OWN + "place")))
    cuts = plan.groupBy(source).agg(F.first(whole).alias(whole), last.alias(OWN + "cut"))
    at = plan.withColumnRenamed(source, source + "2").join(
        cuts, F.col(source + "2").eqNullSafe(F.col(source)) & (F.col(OWN + "place") == F.col(OWN + "cut"))
    )
    at = at.groupBy(source + "2").agg(F.count(F.lit(1)).alias(OWN + "m"), F.sum("more").alias(OWN + "c"))
    cuts = cuts.join(at, F.col(source).eqNullSafe(F.col(source + "2")), "left").drop(source + "2")
    return written(cuts, "mix-cuts")


def mixed_copies(docs: DataFrame) -> DataFrame:
    """The documents, each row as often as the mix takes it, also rows without an id or with one that repeats.

    The rows taken once more are the first of their source's order, so two numbers a source tell how often each row
    is taken: texts are read, but neither written nor shuffled. Of rows alike in all columns some may be taken more
    often; these are counted, once, if there are any.
    """
    source, row, times = OWN + "source", OWN + "row", OWN + "times"
    rows = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    cuts = source_cuts(rows, row)
    rows = rows.withColumn(OWN + "seed", seeded("doc_id")).withColumn(OWN + "size", word_count(F.col("text")))
    rows = rows.filter(F.col(OWN + "size") > 0).withColumn(OWN + "place", _place(row))
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col(source)))
    at_cut = F.coalesce(F.col(OWN + "place") == F.col(OWN + "cut"), F.lit(False))
    split = at_cut & (F.col(OWN + "c") < F.col(OWN + "m"))
    more = F.when(F.col(OWN + "place") <= F.col(OWN + "cut"), 1).otherwise(0)
    taken = rows.filter(~split).withColumn(times, F.col(OWN + "whole") + more)
    if not cuts.filter(F.col(OWN + "c") < F.col(OWN + "m")).isEmpty():
        total = F.max(F.col(OWN + "whole") * F.col(OWN + "m") + F.col(OWN + "c"))
        alike = rows.filter(split).groupBy(*[F.col(f"`{c}`") for c in docs.columns]).agg(total.alias(times))
        taken = taken.select(*docs.columns, times).unionByName(alike)
    repeat = F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))
    return taken.filter(F.col(times) > 0).withColumn(OWN + "copy", repeat).select(*docs.columns)


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS seed
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS s,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, (2 * s)::DOUBLE / w AS ratio FROM s),
c AS (
  SELECT *, row_number() OVER o AS n, sum(s) OVER () AS total, sum(w) OVER () AS weights,
         coalesce(sum(s) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0,
         coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
l AS (
  SELECT *, (3 * total - 4 * s0)::DOUBLE / (2 * (weights - w0))::DOUBLE AS level FROM c),
t AS (
  SELECT source, s, w, ratio, (SELECT arg_min(level, n) FROM l WHERE level < ratio) AS water FROM l),
g AS (
  SELECT source, s, CASE WHEN coalesce(ratio <= water, true) THEN (2 * s)::DOUBLE ELSE water * w END AS target FROM t),
x AS (
  SELECT d.doc_id, d.size, g.s, g.target, floor(g.target / greatest(g.s, 1)::DOUBLE) AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.seed, d.doc_id NULLS LAST, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, s AS source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE size * (whole::BIGINT + CASE
          WHEN (2 * before + size)::DOUBLE <= 2 * (target - whole * s) AND whole < 2 THEN 1 ELSE 0 END) END)::BIGINT
         AS taken
FROM x
"""
