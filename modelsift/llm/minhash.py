"""MinHash near-dedup: banded candidates, odd sketches to pick them, full sets to confirm them.

A document's set holds its distinct shingles of 3 words, or of the width asked for (A-Z lower-cased; a shorter
text is one shingle). Equal sets are one class at once, so copies never meet pair by pair. Each class gets 512
MinHash samples, of which 256 are cut into 32 bands of 8, and an odd sketch: every (place, sample) flips one of
2,048 bits, so the population count of two sketches' XOR grows with the samples that differ and estimates high
similarities. A pair goes on if its count is within four standard deviations of what a similarity of 0.85 gives.
For another percent the bound follows it, and so does the number of bands (56 at 0.80).

Links are found in three steps, each joining only classes that are not yet connected:
1. in each bucket the class that meets most others is the centre and is paired with the members; each class
   confirms its likeliest centre;
2. the other likely centres that lie in another component are confirmed;
3. in buckets that still hold several components, members outside the largest are compared with all others.
Work inside a bucket is thus a star, plus what the stars left apart, never all pairs; no pair is dropped for
a bucket's size. Every link is confirmed on both full sets. A pair of similarity 0.85 shares no band with a
chance of 4e-5 (3e-5 at 0.80) and fails the sketch with a chance of 3e-5.

Null or empty texts have no set and are linked with nothing; so are rows without an id. Rows that repeat an id
count as one document. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.llm import hashing
from modelsift.llm.common import components, table
from modelsift.session import written

SHINGLE = 3
PERCENT = 85  # 100 * intersection >= PERCENT * union
ROWS = 8  # samples of a band
SAMPLES = 512  # the first bands * ROWS make the bands, all make the sketch
MISSED = 1e-4  # chance that a pair of just the similarity shares no band, at most
SKETCH_BITS = 2048
LONGS = SKETCH_BITS // 64
DEVIATIONS = 4.0

SIGNATURE = "struct<n:bigint,key:binary,bands:array<bigint>,sketch:array<bigint>>"


def most_odd_bits(similarity: float = PERCENT / 100, deviations: float = DEVIATIONS) -> int:
    """Largest population count of two sketches' XOR at which a pair of this similarity is still expected."""
    differ = 2 * SAMPLES * (1 - similarity)
    keep = np.exp(-2 * differ / SKETCH_BITS)
    mean = SKETCH_BITS * (1 - keep) / 2
    by_samples = 2 * np.sqrt(SAMPLES * similarity * (1 - similarity)) * keep
    by_bits = np.sqrt(SKETCH_BITS * (1 - keep**2) / 4 - differ * keep**2)
    return int(np.ceil(mean + deviations * np.hypot(by_samples, by_bits)))


def bands_of(percent: int) -> int:
    """The fewest bands, in eights, that a pair of this similarity misses with a chance of MISSED at most."""
    miss = 1 - (percent / 100) ** ROWS
    for bands in range(8, SAMPLES // ROWS + 1, 8):
        if miss**bands <= MISSED:
            return bands
    raise ValueError(f"{SAMPLES} samples are too few for a similarity of {percent} %")


def _multipliers() -> np.ndarray:
    return hashing.mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(hashing.BASE)) | np.uint64(1)


def shingle_sets(chunk: hashing.Chunk, width: int = SHINGLE):
    """The sorted distinct shingle hashes of each row of a chunk."""
    data = hashing.ascii_lower(chunk.data)
    found = hashing.runs(hashing.in_words(data), chunk.offsets)
    words = hashing.Prefixes(data)(found.starts, found.ends)
    shingles, bounds = hashing.sequence_hashes(words, width, found.bounds)
    for i in range(chunk.rows):
        a, b = found.bounds[i], found.bounds[i + 1]
        if b - a >= width:
            yield np.unique(shingles[bounds[i] : bounds[i + 1]])
        elif b > a:
            whole, _ = hashing.sequence_hashes(words[a:b], int(b - a), np.array([0, b - a]))
            yield whole + np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def samples(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[None, at : at + 512] * multipliers[:, None]).min(axis=1), out=least)
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parities of the bits that the (place, sample) pairs fall on."""
    places = np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    bits = hashing.mixed(least + places) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def signatures(width: int, bands: int) -> Callable[[pa.Array], pa.Array]:
    """Sizes, keys, bands and sketches of texts by shingles of this width."""

    def signed(texts: pa.Array) -> pa.Array:
        multipliers = _multipliers()
        weights = hashing.mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        n, keys, cut, sketches = [], [], [], []
        for chunk in hashing.chunks(texts):
            for shingles in shingle_sets(chunk, width):
                n.append(len(shingles))
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                if len(shingles):
                    least = samples(shingles, multipliers)
                    rows = least[: bands * ROWS].reshape(bands, ROWS)
                    cut.append(hashing.mixed((rows * weights).sum(axis=1, dtype=np.uint64)).view(np.int64))
                    sketches.append(odd_sketch(least))
                else:
                    cut.append([])
                    sketches.append([])
        long_list = pa.list_(pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(cut, long_list), pa.array(sketches, long_list)],
            names=["n", "key", "bands", "sketch"],
        )

    return signed


def linked(width: int, percent: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Whether the full sets of two texts overlap enough."""

    def checked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        left = (s for c in hashing.chunks(a) for s in shingle_sets(c, width))
        right = (s for c in hashing.chunks(b) for s in shingle_sets(c, width))
        for x, y in zip(left, right, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return checked


def odd_bits(a: str, b: str) -> Column:
    """Population count of two sketches' XOR."""
    bits = [
        F.bit_count(F.get(f"{a}sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}sketch", F.lit(i)))) for i in range(LONGS)
    ]
    return sum(bits[1:], bits[0])


def likely(a: str, b: str, percent: int) -> Column:
    """Sizes allow the similarity (exact) and the sketches make it likely. a, b: prefixes of columns n and sketch."""
    fits = F.least(f"{a}n", f"{b}n") * 100 >= F.greatest(f"{a}n", f"{b}n") * percent
    return fits & (odd_bits(a, b) <= most_odd_bits(percent / 100))


def first_shared(a: str, b: str) -> Column:
    """Place (from 1) of the first band that two classes share; a pair counts in that bucket alone."""
    return F.array_position(F.zip_with(f"{a}bands", f"{b}bands", lambda x, y: x == y), True)


def _with(df: DataFrame, classes: DataFrame, column: str, prefix: str) -> DataFrame:
    side = classes.select(
        F.col("id").alias(column),
        F.col("n").alias(prefix + "n"),
        F.col("sketch").alias(prefix + "sketch"),
        F.col("bands").alias(prefix + "bands"),
    )
    return df.join(side, column)


def confirmed(pairs: DataFrame, texts: DataFrame, name: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    check = F.arrow_udf(linked(width, percent), "boolean")
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(
        texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b"
    )
    return written(both.filter(check("ta", "tb")).select("a", "b"), f"{name}-links")


def _merged(comp: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """comp(id, comp) after joining what the links connect."""
    to = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(c + "c"))
    edges = links.join(to("a"), "a").join(to("b"), "b").select(F.col("ac").alias("a"), F.col("bc").alias("b"))
    found = components(edges, name).select(F.col("id").alias("comp"), F.col("component"))
    return written(
        comp.join(found, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")), f"{name}-comp"
    )


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    to = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(c + "c"))
    return pairs.join(to("a"), "a").join(to("b"), "b").filter("ac <> bc").select("a", "b")


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, bands: int | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text).

    Linked are texts that share percent of their shingles of width words; the bands follow percent unless given.
    """
    sign = F.arrow_udf(signatures(width, bands or bands_of(percent)), SIGNATURE)
    signed = docs.select(F.col("doc_id").alias("id"), sign(F.coalesce("text", F.lit(""))).alias("s"))
    signed = written(signed.select("id", "s.*"), "dedup-signatures")
    with_set = signed.filter("n > 0 and id is not null")
    classes = written(
        with_set.groupBy("key").agg(
            F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"),
            F.any_value("sketch").alias("sketch"),
        ),
        "dedup-classes",
    )
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text")

    rows = classes.select("id", F.posexplode("bands")).select("id", "pos", F.xxhash64("pos", "col").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = written(rows.join(buckets, "bucket"), "dedup-members")
    # The class that meets most others is the likeliest to be linked with them: the same centre in many buckets.
    degree = members.groupBy("id").agg(F.sum("m").alias("d"))
    centre = members.join(degree, "id").groupBy("bucket").agg(F.max(F.struct("d", F.xxhash64("id"), "id")).alias("c"))
    # The whole table's texts are shuffled once; all three steps read those of the members.
    texts = written(texts.join(members.select("id").distinct(), "id", "left_semi"), "dedup-texts")

    stars = members.join(centre.select("bucket", F.col("c.id").alias("centre")), "bucket").filter("id <> centre")
    stars = stars.select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    stars = _with(_with(stars, classes, "a", "a"), classes, "b", "b").filter(likely("a", "b", percent))
    stars = written(stars.select("a", "b", odd_bits("a", "b").alias("odd")), "dedup-stars")

    best = stars.groupBy("a").agg(F.min_by("b", F.struct("odd", "b")).alias("b"))
    links = confirmed(best, texts, "dedup-best", width, percent)
    comp = members.select("id", F.col("id").alias("comp")).distinct()
    comp = _merged(comp, links, "dedup-1")

    links = confirmed(_apart(stars.select("a", "b"), comp), texts, "dedup-other", width, percent)
    comp = _merged(comp, links, "dedup-2")

    placed = members.select("bucket", "pos", "id").join(comp, "id")
    parts = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
    split = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.max_by("comp", F.struct("m", "comp")).alias("main")
    )
    open_rows = written(placed.join(split.filter("parts > 1").select("bucket", "main"), "bucket"), "dedup-open")
    side = lambda df, p: df.select(
        "bucket", "main", "pos", F.col("id").alias(p), F.col("comp").alias(p + "c"), p + "n", p + "sketch", p + "bands"
    )
    left = side(_with(open_rows.filter("comp <> main"), classes, "id", "a"), "a")
    right = side(_with(open_rows, classes, "id", "b"), "b").drop("main", "pos")
    apart = (F.col("ac") != F.col("bc")) & ((F.col("bc") == F.col("main")) | (F.col("ac") < F.col("bc")))
    rest = (
        left.join(right, "bucket")
        .filter(apart & likely("a", "b", percent) & (first_shared("a", "b") == F.col("pos") + 1))
        .select("a", "b")
    )
    links = confirmed(written(rest, "dedup-rest"), texts, "dedup-rest", width, percent)
    comp = _merged(comp, links, "dedup-3")

    merged = classes.select("key", "id").join(comp, "id", "left").select(
        "key", F.coalesce("comp", "id").alias("component_id")
    )
    result = signed.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("key")).alias("key"))
    result = result.join(merged, "key", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return result.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def op6_minhash_odd_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
