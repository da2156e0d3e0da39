"""Training on every labelled text, block by block."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from modelsift.llm import toxicity
from modelsift.llm.common import held_out, table

LARGER = "/root/testdata/sf0.1"
MARKERS = 250


def test_no_labelled_text_is_left_out(spark):
    """Words of few texts each are all known, whichever texts a sample would have taken."""
    ids = spark.range(10_000).withColumnRenamed("id", "doc_id")
    toxic = F.col("doc_id") % 2
    letters = F.translate((F.floor(F.col("doc_id") / 2) % MARKERS).cast("string"), "0123456789", "abcdefghij")
    around = [F.concat(F.lit(p), F.translate(F.col("doc_id").cast("string"), "0123456789", "klmnopqrst")) for p in ("x", "y")]
    marker = F.concat(F.when(toxic == 1, "bad").otherwise("good"), letters)
    documents = ids.select("doc_id", F.concat_ws(" ", around[0], marker, around[1]).alias("text"))
    labels = ids.select("doc_id", toxic.cast("int").alias("toxic"))
    model = toxicity.fitted(documents, labels)
    words = [w + "".join("abcdefghij"[int(c)] for c in str(i)) for w in ("bad", "good") for i in range(MARKERS)]
    hashes = np.array([toxicity.word_hash(w) for w in words], np.uint64)
    assert (toxicity._rows_of(hashes, model.known, model.place) > 0).mean() > 0.99  # a few share a bucket
    scored = toxicity.toxicity_scores(documents, model).join(labels, "doc_id")
    assert scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0] > 0.99


def test_many_blocks(spark, monkeypatch):
    """Blocks learn as one does, hold every learnable text, and a rerun gives the same model."""
    monkeypatch.setattr(toxicity, "BLOCK_TEXTS", 600)
    documents, labels = table(spark, LARGER, "documents").select("doc_id", "text"), table(spark, LARGER, "labels")
    held = []
    monkeypatch.setattr(toxicity, "written", lambda df, name, write=toxicity.written: held.append(write(df, name)) or held[-1])
    model = toxicity.fitted(documents, labels)
    learnable = labels.filter(~held_out(F.col("doc_id"))).join(documents, "doc_id")
    assert held[0].count() > 4
    assert held[0].agg(F.sum("c0") + F.sum("c1")).first()[0] == learnable.count()
    scored = toxicity.toxicity_scores(documents, model).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    assert scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0] > 0.93
    again = toxicity.fitted(documents.repartition(13), labels.repartition(3))
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.thresholds, again.thresholds)


def test_cut_between_grid_steps():
    clean, toxic = np.zeros(toxicity.GRID + 1, np.int64), np.zeros(toxicity.GRID + 1, np.int64)
    clean[toxicity.GRID // 4], toxic[toxicity.GRID // 2] = 30, 20
    assert toxicity._cut(clean, toxic) == 0.375


def _block(n_texts, n_words, seed=3):
    """One packed block of texts of 1 to 2 * n_words words, some empty and one long, and a model that knows its words."""
    rng = np.random.default_rng(seed)
    vocabulary = ["w" + "".join("abcdefghij"[int(c)] for c in str(i)) for i in range(500)] + ["the", "und", "les", "los"]
    sizes = rng.integers(1, 2 * n_words, n_texts)
    sizes[::50], sizes[7] = 0, 40 * n_words
    texts = [" ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), n)) for n in sizes]
    ids = np.arange(n_texts)
    columns = {"doc_id": ids, "text": texts, "tie": ids, "label": ids % 2}
    block = next(toxicity.packed(iter([pa.RecordBatch.from_pydict(columns)])))
    hashes = np.array([toxicity.word_hash(w) for w in vocabulary[::2]], np.uint64)
    known, place = np.zeros(toxicity.BUCKETS, np.uint64), np.zeros(toxicity.BUCKETS, np.int32)
    at = (hashes % np.uint64(toxicity.BUCKETS)).astype(np.int64)
    known[at], place[at] = hashes, np.arange(len(at)) + 1
    return block, toxicity.started(known, place, np.concatenate([[0.0], rng.normal(0, 2, len(at))]))


def _points(block, model):
    return next(toxicity.block_points(model)(iter([block])))


def test_pieces_score_as_whole_blocks(monkeypatch):
    block, model = _block(400, 60)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 1 << 30)
    whole = _points(block, model)
    assert sum(whole["n"].to_pylist()) == 400
    for n in (1, 100, 5_000):
        monkeypatch.setattr(toxicity, "PIECE_WORDS", n)
        assert _points(block, model).equals(whole)


def test_scoring_a_block_holds_one_piece():
    """The memory of calibration does not grow with the block: about 1.2 million words, then twice as many."""
    peaks = []
    for n_texts in (4_000, 8_000):
        block, model = _block(n_texts, 300)
        tracemalloc.start()
        _points(block, model)
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[0] < 40 and peaks[1] < 1.2 * peaks[0], peaks
