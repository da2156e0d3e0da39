"""Best-fit packing with several permitted sequence lengths.

A document longer than the largest length is cut into pieces of that length and a rest. Pieces get a seeded
global order that is cut into blocks of BLOCK pieces, so that every block holds a mixture and no task more than
that. Within a block pieces are placed from long to short: into the bin whose free space fits best, else into
a new bin of the size that costs least, where free space that later pieces can still fill is credited at the
cheapest price of a token. At the end each bin shrinks to the shortest permitted length that holds its contents.

Lengths are words of the whole text, or the column named. Pieces of no length (null or empty texts) are
returned without a bin. Rows that repeat an id are its copies, numbered from 0 by length and text and packed one by one;
the number is part of the seeded order, and two copies of one id never share a bin, that is a training sequence. Rows
without an id are no copies of each other, though numbered alike. Columns besides doc_id and text are not looked at. An
empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.llm.common import OWN, ranked, table, word_count, words
from modelsift.session import written

CAPACITIES = (512, 1024, 2048, 4096)
BLOCK = 1024
SEED = "pack-1"
OVERHEAD = 32  # words' worth that any sequence costs
QUADRATIC = 1 / 32768  # attention grows with the square of the length


def cost(capacity: int) -> float:
    return OVERHEAD + capacity + QUADRATIC * capacity**2


def packed(lengths: list[int], capacities=CAPACITIES, copies: list[tuple | None] | None = None) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset in it, its final capacity) of each piece; lengths are positive, at most the largest capacity.

    copies: (document, copy) of each piece; a bin takes no second copy of a document, so the next best bin is tried.
    """
    capacities = sorted(capacities)
    price = min(cost(c) / c for c in capacities)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    free: list[tuple[int, int]] = []  # sorted (space, bin)
    used: list[int] = []
    size: list[int] = []
    held: list[dict] = []  # of each bin, the copy of each document in it
    left = sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        left -= n
        document, copy = (copies[i] if copies else None) or (None, 0)
        at = bisect_left(free, (n, -1))
        while at < len(free) and held[free[at][1]].get(document, copy) != copy:
            at += 1
        if at < len(free):
            _, b = free.pop(at)
        else:
            b = len(used)
            used.append(0)
            held.append({})
            size.append(min((c for c in capacities if c >= n), key=lambda c: cost(c) - price * min(c - n, left)))
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if document is not None:
            held[b][document] = copy
        if used[b] < size[b]:
            insort(free, (size[b] - used[b], b))
    final = [next(c for c in capacities if c >= u) for u in used]
    return bins, offsets, [final[b] for b in bins]


def block_packer(capacities=CAPACITIES):
    def pack(group: pa.Table) -> pa.Table:
        rows = group.sort_by(OWN + "position")
        lengths = rows["length"].to_pylist()
        real = [i for i, n in enumerate(lengths) if n > 0]
        ids, copies = rows["doc_id"].to_pylist(), rows["copy"].to_pylist()
        known = [(ids[i], copies[i]) if ids[i] is not None else None for i in real]
        bins, offsets, final = packed([lengths[i] for i in real], capacities, known)
        first = rows["block"][0].as_py() * BLOCK if lengths else 0
        columns: dict[str, list] = {"bin": [None] * len(lengths), "offset": [None] * len(lengths), "capacity": [None] * len(lengths)}
        for k, i in enumerate(real):
            columns["bin"][i], columns["offset"][i], columns["capacity"][i] = first + bins[k], offsets[k], final[k]
        out = rows.select(["doc_id", "copy", "piece", "start", "length", "text_key"])
        for name, values in columns.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return pack


def numbered(docs: DataFrame, length: Column | None) -> DataFrame:
    """(doc_id, copy, length, text_key) of every row; the copies of an id are counted in one sort, not in a window."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (word_count(F.col("text")) if length is None else length).alias(OWN + "n"),
        (F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")).alias("text_key"),
    )
    rows = ranked(rows, [F.asc_nulls_first("doc_id"), F.asc(OWN + "n"), F.asc("text_key")], "pack-copies")
    first = rows.groupBy(F.col("doc_id").alias(OWN + "id")).agg(
        F.min(OWN + "position").alias(OWN + "first"), F.count(F.lit(1)).alias(OWN + "rows")
    )
    # Ids that occur once are copy 0, so only those that repeat are joined.
    first = written(first.filter(F.col(OWN + "rows") > 1).drop(OWN + "rows"), "pack-repeated")
    rows = rows.join(first, F.col("doc_id").eqNullSafe(F.col(OWN + "id")), "left")
    copy = F.coalesce(F.col(OWN + "position") - F.col(OWN + "first"), F.lit(0)).cast("long")
    return rows.select("doc_id", copy.alias("copy"), OWN + "n", "text_key")


def best_fit(docs: DataFrame, capacities=CAPACITIES, length: Column | None = None) -> DataFrame:
    """(doc_id, copy, piece, start, length, text_key, bin, offset, capacity) of every piece of docs(doc_id, text)."""
    longest = max(capacities)
    last = F.greatest(F.ceil(F.col(OWN + "n") / longest) - 1, F.lit(0)).cast("int")
    pieces = numbered(docs, length).withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        "doc_id",
        "copy",
        F.col("piece").cast("long").alias("piece"),
        (F.col("piece") * F.lit(longest).cast("long")).alias("start"),
        F.least(F.col(OWN + "n") - F.col("piece") * F.lit(longest), F.lit(longest)).cast("long").alias("length"),
        "text_key",
    )
    mixed = F.xxhash64(F.lit(SEED), "doc_id", "copy", "piece")
    order = [F.asc(OWN + "mixed"), F.asc_nulls_first("doc_id"), F.asc("copy"), F.asc("piece")]
    rows = ranked(pieces.withColumn(OWN + "mixed", mixed), order, "pack-order").drop(OWN + "mixed")
    blocks = rows.withColumn("block", F.floor(F.col(OWN + "position") / BLOCK).cast("long"))
    return blocks.groupBy("block").applyInArrow(
        block_packer(capacities),
        "doc_id bigint, copy bigint, piece bigint, start bigint, length bigint, text_key bigint, bin bigint, offset bigint, "
        "capacity bigint",
    )


def packed_texts(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The placed pieces with their text: the whole text of an uncut document, else the piece's words.

    A row's text is known by its id and the text's hash, so rows that repeat an id keep their own texts.
    """
    ids = [F.col("doc_id").cast("long").alias(OWN + "id"), F.xxhash64("text").alias(OWN + "text_key")]
    one = docs.groupBy(*ids).agg(F.max("text").alias(OWN + "text"))
    same = F.col("doc_id").eqNullSafe(F.col(OWN + "id")) & (F.col("text_key") == F.col(OWN + "text_key"))
    rows = placed.join(one, same, "left")
    all_words = words(F.col(OWN + "text"))
    part = F.array_join(F.slice(all_words, F.col("start").cast("int") + 1, F.col("length").cast("int")), " ")
    whole = (F.col("start") == 0) & (F.col("length") == F.size(all_words))
    return rows.select(*placed.columns, F.when(whole, F.col(OWN + "text")).otherwise(part).alias("text"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit(table(spark, folder, "documents").select("doc_id", "text"))
