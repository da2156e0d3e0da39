"""Toxicity: a convolutional text classifier over hashed words, with thresholds calibrated by language.

Words are runs of letters in lower case, known by a 64-bit hash. Words of the training texts that occur in
enough different contexts have a learned vector, found by the hash's bucket and confirmed by the whole hash; all others have
the zero vector. Filters of several widths slide over the vectors, each keeps its maximum over the whole text, and
a logistic layer gives the probability. Vectors, filters and layer are trained in numpy by stochastic gradient
descent; the first component of a vector starts at the word's log-odds between the classes.

All labelled texts that may be learned from are used. Spark deals them by their id into blocks (see block_count), and a
task packs a block: numbered words, and of each word its contexts by class. The vocabulary is the sum over all
blocks. Every block trains from the same start; of each word's vector the mean over the blocks that have the word is
taken, of all other parameters the mean over all blocks. Up to one block of texts this is plain gradient descent.

The language is guessed from the text alone, by which language's function words are most frequent in it. Each
language has the threshold that separates all its training texts best, counted on a grid of GRID steps; scores are
stretched so that it is 0.5.

Null and empty texts score as a text without known words. Rows are scored one by one, so ties and repeated rows
agree; sums over blocks are exact, so reruns agree. An empty table gives no rows. Without labelled texts of both
classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.llm import hashing
from modelsift.llm.common import held_out, labelled, table
from modelsift.session import written

BUCKETS = 1 << 17
DIMS = 6
WIDTHS = (1, 2, 3)
FILTERS = 4  # of each width
BLOCK_TEXTS = 4_000  # labelled texts that are trained on together, about
BLOCK_BYTES = 32 << 20  # most text that is dealt to one task, about
PIECE_WORDS = 1 << 16  # of a block's texts that are scored at once
MIN_CONTEXTS = 6
SMOOTHING = 2.0
EPOCHS = 6
RATE = 0.1
CLEAN_COST = 3.0  # of a clean text rejected, against a toxic one kept
REJECT_AT = 0.5
GRID = 1 << 14  # steps of a probability when thresholds are sought
FIXED = float(1 << 40)  # parameters are summed as whole multiples of 1 / FIXED

BLOCK = (
    "c0 bigint, c1 bigint, words array<bigint>, n0 array<bigint>, n1 array<bigint>, "
    "labels array<int>, bounds array<bigint>, ids array<int>"
)

# Function words of each language at hand.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with be by this at from or".split(),
    "de": "der die das und ist von zu den mit sich des auf im dem nicht ein eine als auch für".split(),
    "fr": "le la les et des un une du en que qui dans est pour sur pas au par avec ce".split(),
    "es": "el los las y que del una con su por para lo al como más pero se es la de".split(),
}
LANGUAGES = sorted(FUNCTION_WORDS)


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hashing.Prefixes(data)(np.array([0]), np.array([len(data)]))[0])


@dataclass
class Model:
    """Of every bucket: the hash it stands for and its vector (row 0: unknown). filters[w]: (w, DIMS, FILTERS)."""

    known: np.ndarray
    place: np.ndarray
    vectors: np.ndarray
    filters: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    layer: np.ndarray
    bias: float
    thresholds: np.ndarray
    language_hashes: np.ndarray
    language_of: np.ndarray


def text_words(chunk: hashing.Chunk) -> tuple[np.ndarray, np.ndarray]:
    low, letters = hashing.letters_lower(chunk.data)
    found = hashing.runs(letters, chunk.offsets)
    return hashing.Prefixes(low)(found.starts, found.ends), found.bounds


def languages(words: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Guessed language of each row; a function word shared by languages counts for each."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
    hit = hashes[at] == words
    votes = np.zeros((len(bounds) - 1, len(LANGUAGES)))
    np.add.at(votes, rows[hit], of[at[hit]])
    return votes.argmax(axis=1)


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    words = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})
    hashes = np.array([word_hash(w) for w in words], np.uint64)
    of = np.array([[w in FUNCTION_WORDS[x] for x in LANGUAGES] for w in words], np.float64)
    of /= of.sum(axis=1, keepdims=True)
    order = np.argsort(hashes)
    return hashes[order], of[order]


def _contexts(words: np.ndarray) -> np.ndarray:
    """Hash of each word with its neighbours."""
    padded = np.concatenate([np.zeros(1, np.uint64), words, np.zeros(1, np.uint64)])
    return hashing.sequence_hashes(padded, 3, np.array([0, len(padded)]))[0]


def _context_counts(texts: list[np.ndarray], labels: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By class, in how many distinct contexts each of the sorted words stands.

    Words are counted by distinct contexts, so the copies of one text do not make its words telling.
    """
    counts = []
    for label in (0, 1):
        own = [t for t, y in zip(texts, labels, strict=True) if y == label]
        if not own:
            counts.append(np.zeros(len(words), np.int64))
            continue
        found, contexts = np.concatenate(own), np.concatenate([_contexts(t) for t in own])
        first = found[np.unique(contexts, return_index=True)[1]]
        counts.append(np.bincount(np.searchsorted(words, first), minlength=len(words)))
    return counts[0], counts[1]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a partition's texts: their labels, words as numbers into the sorted hashes, contexts by class."""
    texts, ids, ties, labels = [], [], [], []
    for batch in batches:
        for chunk in hashing.chunks(batch.column("text")):
            words, bounds = text_words(chunk)
            texts += [words[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        ids.append(batch.column("doc_id").to_numpy())
        ties.append(batch.column("tie").to_numpy())
        labels.append(batch.column("label").to_numpy())
    if not texts:
        return
    order = np.lexsort((np.concatenate(ties), np.concatenate(ids)))
    y = np.concatenate(labels)[order]
    texts = [texts[i] for i in order]
    words, numbers = np.unique(np.concatenate(texts), return_inverse=True)
    n0, n1 = _context_counts(texts, y, words)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row = {
        "c0": pa.array([(y == 0).sum()], pa.int64()),
        "c1": pa.array([(y == 1).sum()], pa.int64()),
        "words": _list(words.view(np.int64), pa.int64()),
        "n0": _list(n0, pa.int64()),
        "n1": _list(n1, pa.int64()),
        "labels": _list(y, pa.int32()),
        "bounds": _list(bounds, pa.int64()),
        "ids": _list(numbers, pa.int32()),
    }
    yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes of the distinct words, the texts as numbers into them, bounds of the texts, labels) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            words, ids, bounds, labels = (
                batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("words", "ids", "bounds", "labels")
            )
            yield words.view(np.uint64), ids, bounds, labels


def _pieces(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most PIECE_WORDS words together; a longer text is a run of its own."""
    start, end = 0, len(bounds) - 1
    while start < end:
        stop = int(np.searchsorted(bounds, bounds[start] + PIECE_WORDS, "right")) - 1
        stop = max(start + 1, stop)
        yield start, stop
        start = stop


def vocabulary(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each bucket, its row, log-odds by row) of the words in at least MIN_CONTEXTS contexts of all blocks."""
    total = blocks.agg(*[F.sum(F.aggregate(n, F.lit(0).cast("bigint"), lambda a, b: a + b)).alias(n) for n in ("n0", "n1")])
    t0, t1 = total.first()
    ratio = t1 / max(t0, 1)
    of_block = blocks.select(F.inline(F.arrays_zip("words", "n0", "n1")))
    counts = of_block.groupBy("words").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + SMOOTHING * ratio) / (F.col("n0") + SMOOTHING)) - float(np.log(max(ratio, 1e-9)))
    often = counts.filter(F.col("n0") + F.col("n1") >= MIN_CONTEXTS).select("words", odds.alias("odds"))
    bucket = F.pmod("words", F.lit(BUCKETS))
    # Of words in one bucket, the more telling stays.
    kept = often.groupBy(bucket.alias("bucket")).agg(F.max(F.struct(F.abs("odds").alias("a"), "words", "odds")).alias("w"))
    rows = kept.select("bucket", "w.words", "w.odds").toArrow().sort_by("bucket")
    known, place = np.zeros(BUCKETS, np.uint64), np.zeros(BUCKETS, np.int32)
    at = rows["bucket"].to_numpy()
    known[at] = rows["words"].to_numpy().view(np.uint64)
    place[at] = np.arange(len(at)) + 1
    return known, place, np.concatenate([[0.0], rows["odds"].to_numpy()])


def _rows_of(words: np.ndarray, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    bucket = (words % np.uint64(BUCKETS)).astype(np.int64)
    return np.where(known[bucket] == words, place[bucket], 0)


def _windows(ids: np.ndarray, width: int) -> np.ndarray:
    """Word rows of each window; a text is padded with unknown words to one window at least."""
    padded = np.concatenate([ids, np.zeros(max(0, width - len(ids)), ids.dtype)])
    return np.lib.stride_tricks.sliding_window_view(padded, width)


def _unique_windows(texts: list[np.ndarray], row_of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each width the distinct windows of all texts in one array, and each text's bounds in it."""
    found = []
    for w in WIDTHS:
        rows = np.empty((sum(max(len(t) - w + 1, 1) for t in texts), w), np.int32)
        bounds = np.zeros(len(texts) + 1, np.int64)
        for i, ids in enumerate(texts):
            own = np.unique(_windows(row_of[ids], w), axis=0)
            bounds[i + 1] = bounds[i] + len(own)
            rows[bounds[i] : bounds[i + 1]] = own
        found.append((rows, bounds))
    return found


def started(known: np.ndarray, place: np.ndarray, odds: np.ndarray, seed: int = 5) -> Model:
    """The model that every block trains on from."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (len(odds), DIMS))
    vectors[:, 0] = odds / 4
    vectors[0] = 0
    filters = {w: rng.normal(0, 0.1, (w, DIMS, FILTERS)) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][:, 0, :] += 1 / w
    offsets = {w: np.full(FILTERS, -0.1) for w in WIDTHS}
    layer, bias = rng.normal(0.5, 0.1, len(WIDTHS) * FILTERS), -1.0
    hashes, of = _language_table()
    return Model(known, place, vectors, filters, offsets, layer, bias, np.full(len(LANGUAGES), 0.5), hashes, of)


def trained(
    model: Model, texts: list[np.ndarray], row_of: np.ndarray, labels: np.ndarray, weight: np.ndarray, seed: int = 7
) -> Model:
    """The model after gradient descent from there over texts (numbers into row_of); weight: of a text by its class."""
    rng = np.random.default_rng(seed)
    vectors, layer, bias = model.vectors.copy(), model.layer.copy(), model.bias
    filters, offsets = ({w: v.copy() for w, v in of.items()} for of in (model.filters, model.offsets))
    # Windows without a known word give the filter's offset whatever their place: one of them is enough.
    windows = _unique_windows(texts, row_of)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(texts)):
            best, pooled = [], []
            for k, w in enumerate(WIDTHS):
                rows, bounds = windows[k]
                own = rows[bounds[i] : bounds[i + 1]]
                x = vectors[own]  # windows, width, dims
                z = x.reshape(len(x), -1) @ filters[w].reshape(-1, FILTERS) + offsets[w]
                at = z.argmax(axis=0)
                best.append(own[at])
                pooled.append(z[at, np.arange(FILTERS)])
            z = np.concatenate(pooled)
            h = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ layer + bias, -30, 30)))
            g = (p - labels[i]) * weight[labels[i]]
            back = g * layer * (z > 0)
            layer -= rate * (g * h + 1e-4 * layer)
            bias -= rate * g
            for k, w in enumerate(WIDTHS):
                b = back[k * FILTERS : (k + 1) * FILTERS]
                if not b.any():
                    continue
                x = vectors[best[k]]  # filters, width, dims
                dx = b[:, None, None] * filters[w].transpose(2, 0, 1)
                filters[w] -= rate * 0.1 * (b[:, None, None] * x).transpose(1, 2, 0)
                offsets[w] -= rate * 0.1 * b
                np.add.at(vectors, best[k], -rate * dx)
                vectors[0] = 0
    return replace(model, vectors=vectors, filters=filters, offsets=offsets, layer=layer, bias=float(bias))


def _parameters(model: Model) -> np.ndarray:
    """All parameters but the vectors, as rows of DIMS numbers."""
    flat = [*[model.filters[w].ravel() for w in WIDTHS], *[model.offsets[w] for w in WIDTHS], model.layer, [model.bias]]
    numbers = np.concatenate(flat)
    return np.concatenate([numbers, np.zeros(-len(numbers) % DIMS)]).reshape(-1, DIMS)


def _with_parameters(model: Model, rows: np.ndarray) -> Model:
    numbers, at = rows.ravel(), 0
    filters, offsets = {}, {}
    for w in WIDTHS:
        n = w * DIMS * FILTERS
        filters[w], at = numbers[at : at + n].reshape(w, DIMS, FILTERS), at + n
    for w in WIDTHS:
        offsets[w], at = numbers[at : at + FILTERS], at + FILTERS
    n = len(WIDTHS) * FILTERS
    return replace(model, filters=filters, offsets=offsets, layer=numbers[at : at + n], bias=float(numbers[at + n]))


def block_trainer(model: Model, weight: np.ndarray):
    """Rows (id, v0, v1, ...) of each block: the vectors of its words, and under ids below 0 all other parameters."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, ids, bounds, labels in _unpacked(batches):
            texts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            row_of = _rows_of(words, model.known, model.place)
            after = trained(model, texts, row_of, labels, weight)
            own = np.unique(row_of)
            own, others = own[own > 0], _parameters(after)
            ids = np.concatenate([own, -1 - np.arange(len(others))])
            values = np.rint(np.concatenate([after.vectors[own], others]) * FIXED).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int32()), *[pa.array(values[:, d]) for d in range(DIMS)]],
                names=["id", *[f"v{d}" for d in range(DIMS)]],
            )

    return train


def trained_on(blocks: DataFrame, model: Model, weight: np.ndarray) -> Model:
    """The mean of what the blocks have learned, each from model."""
    names = [f"v{d}" for d in range(DIMS)]
    learned = blocks.select("words", "ids", "bounds", "labels").mapInArrow(
        block_trainer(model, weight), "id int, " + ", ".join(f"{c} bigint" for c in names)
    )
    sums = learned.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names])
    rows = sums.toArrow().sort_by("id")
    ids = rows["id"].to_numpy()
    means = np.stack([rows[c].to_numpy() for c in names], axis=1) / (FIXED * rows["n"].to_numpy()[:, None])
    vectors = model.vectors.copy()
    vectors[ids[ids > 0]] = means[ids > 0]
    return _with_parameters(replace(model, vectors=vectors), means[ids < 0][::-1])


def block_points(model: Model):
    """Rows (language, p, label, n): the texts of each block, counted by guessed language, step of the grid and label.

    A block is scored piece by piece, as the arrays of a score take many times the space of its words.
    """

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, ids, bounds, labels in _unpacked(batches):
            p, language = np.empty(len(labels), np.int64), np.empty(len(labels), np.int64)
            for a, b in _pieces(bounds):
                own, within = words[ids[bounds[a] : bounds[b]]], bounds[a : b + 1] - bounds[a]
                p[a:b] = np.rint(_probabilities(model, own, within) * GRID)
                language[a:b] = languages(own, within, model.language_hashes, model.language_of)
            found, n = np.unique(np.stack([language, p, labels]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*found, n)], names=["language", "p", "label", "n"])

    return points


def calibrated(blocks: DataFrame, model: Model) -> Model:
    """Threshold by language: the middle of the widest best cut between its training texts."""
    every = blocks.select("words", "ids", "bounds", "labels").mapInArrow(
        block_points(model), "language bigint, p bigint, label bigint, n bigint"
    )
    rows = every.groupBy("language", "p", "label").agg(F.sum("n").alias("n")).toArrow()
    language, p, label, n = (rows[c].to_numpy() for c in ("language", "p", "label", "n"))

    def counts(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(p[own & (label == v)], n[own & (label == v)], GRID + 1) for v in (0, 1))

    thresholds = np.empty(len(LANGUAGES))
    for k in range(len(LANGUAGES)):
        clean, toxic = counts(language == k)
        enough = clean.sum() + toxic.sum() >= 40 and clean.any() and toxic.any()
        thresholds[k] = _cut(clean, toxic) if enough else _cut(*counts(language >= 0))
    return replace(model, thresholds=thresholds)


def _cut(clean: np.ndarray, toxic: np.ndarray) -> float:
    """From the number of texts at each step of the grid."""
    at = np.flatnonzero(clean + toxic)
    p, clean, toxic = at / GRID, clean[at], toxic[at]
    cuts = np.concatenate([[0.0], (p[1:] + p[:-1]) / 2, [1.0]])
    clean_above = clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    toxic_below = np.concatenate([[0], np.cumsum(toxic)])
    errors = CLEAN_COST * clean_above / max(clean.sum(), 1) + toxic_below / max(toxic.sum(), 1)
    gaps = np.diff(np.concatenate([[0.0], p, [1.0]]))
    best = np.lexsort((-gaps, np.round(errors, 9)))[0]
    return float(np.clip(cuts[best], 0.02, 0.98))


def _probabilities(model: Model, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each row; the filters' sums are looked up by word and place in the window."""
    ids = _rows_of(words, model.known, model.place)
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    # Only windows with a known word can differ from the filter's offset.
    hits = np.flatnonzero(ids)
    pooled = []
    for w in WIDTHS:
        most = np.full((n, FILTERS), -np.inf)
        plain = np.diff(bounds) < w
        sums = model.vectors @ model.filters[w]  # width, words, filters
        starts = np.unique(hits[:, None] - np.arange(w)[None, :])
        starts = starts[(starts >= 0) & (starts + w <= len(ids))]
        starts = starts[rows[starts] == rows[starts + w - 1]]
        z = model.offsets[w] + sum(sums[k][ids[starts + k]] for k in range(w))
        if len(starts):
            own = rows[starts]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            most[own[first]] = np.maximum.reduceat(z, first, axis=0)
        used = np.bincount(rows[starts], minlength=n)
        rest = used < np.maximum(np.diff(bounds) - w + 1, 0)
        most[rest] = np.maximum(most[rest], model.offsets[w])
        for i in np.flatnonzero(plain):  # shorter than the filter: one padded window
            own = ids[bounds[i] : bounds[i + 1]]
            most[i] = model.offsets[w] + sum((sums[k][own[k]] for k in range(len(own))), np.zeros(FILTERS))
        pooled.append(most)
    h = np.maximum(np.concatenate(pooled, axis=1), 0)
    return 1 / (1 + np.exp(-np.clip(h @ model.layer + model.bias, -30, 30)))


def scorer(model: Model | None):
    def scores(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.zeros(len(texts)), pa.float64())
        out = []
        for chunk in hashing.chunks(texts):
            words, bounds = text_words(chunk)
            p = _probabilities(model, words, bounds)
            cut = model.thresholds[languages(words, bounds, model.language_hashes, model.language_of)]
            out.append(np.where(p < cut, 0.5 * p / cut, 0.5 + 0.5 * (p - cut) / (1 - cut)))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return scores


def block_count(documents: DataFrame, n_labels: int) -> int:
    """So many that a block has about BLOCK_TEXTS labelled texts, and a task about BLOCK_BYTES of text at most."""
    n_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, ceil(n_labels / BLOCK_TEXTS), ceil(n_bytes / BLOCK_BYTES))


def fitted(documents: DataFrame, labels: DataFrame) -> Model | None:
    """The model learned from every learnable labelled text; what reaches the driver is as large as the model."""
    learnable = labelled(labels, "toxic")
    n_labels = learnable.count()
    if not n_labels:
        return None
    n = block_count(documents, n_labels)
    texts = documents.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie")
    )
    dealt = texts.repartition(n, "doc_id").join(learnable.repartition(n, "doc_id"), "doc_id")
    blocks = written(dealt.mapInArrow(packed, BLOCK), "toxicity-blocks")
    classes = blocks.agg(F.sum("c0"), F.sum("c1")).first()
    if not all(classes):
        return None
    weight = sum(classes) / (2 * np.array(classes))
    model = trained_on(blocks, started(*vocabulary(blocks)), weight)
    return calibrated(blocks, model)


def toxicity_scores(documents: DataFrame, model: Model | None) -> DataFrame:
    """documents with score and predicted."""
    score = F.arrow_udf(scorer(model), "double")
    scored = documents.withColumn("score", score(F.coalesce("text", F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= REJECT_AT).cast("int"))


def op9_toxicity_cnn(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = fitted(documents, table(spark, folder, "labels"))
    return toxicity_scores(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
