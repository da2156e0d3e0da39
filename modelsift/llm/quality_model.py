"""Quality classifier: averaged hashed embeddings of words and character n-grams, with a softmax.

Features of a text are its words, the 2- and 4-character n-grams inside its words, and two markers counted per
word (the word equals the one before; the 3-word window occurred before in the text). Each feature has a
hashed row of an embedding; a text is the average over all its features and a softmax layer gives the classes.
Both layers are learned with numpy by stochastic gradient descent on at most 2 * PER_CLASS labelled texts,
whose ids are picked by a hash from the learnable rows. Since averaging and the last layer are linear, a text's
logit is the average of one number per feature; scoring reads that table only.

The score depends on the whole text and nothing else. A null or empty text has no features and scores the
learned prior. Rows are scored one by one, so ties and repeated rows agree; an empty table gives no rows.
Without labels of both classes every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.llm import hashing
from modelsift.llm.common import held_out, labelled_sample, table

BUCKETS = 1 << 17
DIMS = 8
GRAMS = (2, 4)
PER_CLASS = 1_500
EPOCHS = 8
RATE = 0.5
KEEP_AT = 0.3
ECHO, AGAIN = 0, 1  # buckets of the markers


def features(chunk: hashing.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of a chunk and the row of each."""
    data = chunk.data
    marked = hashing.in_words(data)
    found = hashing.runs(marked, chunk.offsets)
    prefix = hashing.Prefixes(data)
    words = prefix(found.starts, found.ends)
    rows = found.rows
    out, of = [_bucket(words)], [rows]
    if len(words):
        echo = np.flatnonzero((words[1:] == words[:-1]) & (rows[1:] == rows[:-1])) + 1
        out.append(np.full(len(echo), ECHO))
        of.append(rows[echo])
        windows, bounds = hashing.sequence_hashes(words, 3, found.bounds)
        at = np.repeat(np.arange(chunk.rows), np.diff(bounds))
        keys = np.sort((hashing.mixed(windows) & ~np.uint64((1 << 20) - 1)) | at.astype(np.uint64))
        again = (keys[1:][keys[1:] == keys[:-1]] & np.uint64((1 << 20) - 1)).astype(np.int64)
        out.append(np.full(len(again), AGAIN))
        of.append(again)
    chars = np.flatnonzero(marked & ((data & 0xC0) != 0x80))
    if len(chars):
        word = np.searchsorted(found.starts, chars, "right") - 1
        for n in GRAMS:
            last = np.append(chars[n:], len(data)) if len(chars) >= n else chars[:0]
            k = len(last)
            inside = word[:k] == word[n - 1 :][:k]
            start, last, own = chars[:k][inside], last[inside], word[:k][inside]
            out.append(_bucket(prefix(start, np.minimum(last, found.ends[own])) + np.uint64(n)))
            of.append(rows[own])
    return np.concatenate(out), np.concatenate(of)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS - 2)).astype(np.int64) + 2


def counted(texts: pa.Array) -> pa.Array:
    """Distinct buckets and counts of each text."""
    buckets, counts = [], []
    for chunk in hashing.chunks(texts):
        f, rows = features(chunk)
        order = np.argsort(rows, kind="stable")
        f = f[order]
        bounds = np.searchsorted(rows[order], np.arange(chunk.rows + 1))
        for i in range(chunk.rows):
            b, c = np.unique(f[bounds[i] : bounds[i + 1]], return_counts=True)
            buckets.append(b.astype(np.int32))
            counts.append(c.astype(np.float32))
    return pa.StructArray.from_arrays(
        [pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], names=["b", "c"]
    )


def trained(samples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 3) -> tuple[np.ndarray, float]:
    """(logit per bucket, bias) after stochastic gradient descent on both layers."""
    labels = np.array([y for _, _, y in samples], np.int64)
    if len(np.unique(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    table_ = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    layer, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(samples)):
            b, c, y = samples[i]
            if not len(b):
                continue
            share = c / c.sum()
            mean = share @ table_[b]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = np.clip(p * np.float32(weight[y]), -4, 4)
            back = layer @ g
            layer -= rate * np.outer(mean, g)
            bias -= rate * 0.1 * g
            # Average over many features: each gets its share, scaled up as if there were few.
            table_[b] -= (rate * len(b) ** 0.5) * share[:, None] * back[None, :]
    return table_ @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def scorer(logits: np.ndarray, bias: float):
    def scores(texts: pa.Array) -> pa.Array:
        out = []
        for chunk in hashing.chunks(texts):
            f, rows = features(chunk)
            total = np.bincount(rows, weights=logits[f], minlength=chunk.rows)
            n = np.bincount(rows, minlength=chunk.rows)
            out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -60, 60))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return scores


def fitted(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    count = F.arrow_udf(counted, "struct<b:array<int>,c:array<float>>")
    sample = labelled_sample(documents, labels, "quality", PER_CLASS)
    rows = sample.select("doc_id", "label", count("text").alias("f")).toArrow()
    rows = rows.sort_by("doc_id")
    f = rows["f"].combine_chunks()
    buckets, counts = f.field("b"), f.field("c")
    made = [
        (np.asarray(buckets[i].values), np.asarray(counts[i].values), y)
        for i, y in enumerate(rows["label"].to_pylist())
    ]
    return trained(made)


def quality_scores(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """documents with score and predicted."""
    score = F.arrow_udf(scorer(*model), "double")
    scored = documents.withColumn("score", score(F.coalesce("text", F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))


def op2_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = fitted(documents, table(spark, folder, "labels"))
    return quality_scores(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
