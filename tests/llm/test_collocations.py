import random
import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from modelsift.llm import collocations
from modelsift.llm.collocations import Tiles
from odd_rows import no_documents, odd_documents  # noqa: F401

import compare
from conftest import SMALL


def over(documents, sql=collocations.SQL):
    con = duckdb.connect()
    con.register("documents", pa.table({"lang": pa.array([r.lang for r in documents], pa.string()), "text": pa.array([r.text for r in documents], pa.string())}))
    cursor = con.execute(sql)
    return compare.rows_of([d[0] for d in cursor.description], cursor.fetchall())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 1300), st.integers(0, 1300)), min_size=1, max_size=80), max_size=5), st.integers(1, 30))
def test_tiles_count_pairs(blocks, dense_at):
    held = collocations.DENSE_AT, collocations.DENSE_TILES
    collocations.DENSE_AT, collocations.DENSE_TILES = dense_at, 2
    try:
        tiles, expected = Tiles(), {}
        for block in blocks:
            left, right = (np.array(c, np.int64) for c in zip(*block, strict=True))
            tiles.add(left, right)
            for pair in block:
                expected[pair] = expected.get(pair, 0) + 1
        keys, counts = tiles.taken()
    finally:
        collocations.DENSE_AT, collocations.DENSE_TILES = held
    assert dict(zip(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist(), strict=True), counts.tolist(), strict=True)) == expected
    assert not tiles.dense and not len(tiles.keys)


@pytest.fixture(scope="module")
def phrases(spark, odd_documents):
    """Phrases within phrases, pieces, mixed case, other white space, two languages with the same words."""
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma", "é", "É", "x y", "<|a|>", "long" * 40, "d", "e"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "!\x0b", " A "]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text + "new york city new york" * (i % 3), rng.choice(["en", "de", None, "und"]), "a", 1, None, None, None))
    return spark.createDataFrame(rows, odd_documents.schema).unionByName(odd_documents).repartition(5)


@pytest.mark.parametrize("rows, size", [(1 << 20, 1 << 20), (4, 1 << 20), (0, 0), (1 << 20, 30)])
def test_phrases_against_sql(spark, phrases, rows, size):
    """With all codes broadcast, with a few, and with none."""
    got = collocations.collocations(phrases, rows=rows, size=size)
    assert compare.rows_of(got.columns, got.collect()) == over(phrases.collect())


def test_sent_in_many_parts(spark, phrases, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 200)
    monkeypatch.setattr(collocations, "HELD_PAIRS", 20)
    batches = [pa.RecordBatch.from_pylist([{"lang": r.lang or "und", "text": r.text or ""} for r in phrases.collect()])]
    sent = list(collocations.word_counter(iter(batches)))
    assert len(sent) > 10
    total = {}
    for b in sent:
        for r in b.to_pylist():
            total[r["lang"], r["phrase"]] = total.get((r["lang"], r["phrase"]), 0) + r["n"]
    whole = collocations.phrase_counts(phrases, 2, min_count=1)[1][0].collect()
    assert total == {(r.lang, r.phrase): r.n for r in whole}


def test_longer_phrases(spark, phrases):
    """Four words: every phrase of a level is counted as a plain count does."""
    levels = collocations.phrase_counts(phrases, 4, rows=9)[1]
    for k, level in enumerate(levels, 1):
        expected = {}
        for r in phrases.collect():
            words = collocations.words_of([(r.text or "").encode()])
            for i in range(len(words) - k + 1):
                if b"A" not in words[i : i + k]:
                    key = (r.lang or "und", b" ".join(words[i : i + k]).decode())
                    expected[key] = expected.get(key, 0) + 1
        assert {(r.lang, r.phrase): r.n for r in level.collect()} == {p: n for p, n in expected.items() if n >= 10}


def counted(texts, lang="en"):
    batches = (pa.RecordBatch.from_pylist([{"lang": lang, "text": t}]) for t in texts)
    return lambda levels: collocations.phrase_counter(SimpleNamespace(value=levels))(batches)


def test_a_task_holds_no_more_without_codes(spark, monkeypatch):
    """Words beyond what is broadcast: a task with eight times the text holds what one with less does."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 4000)
    words = [f"w{i}" for i in range(24_000)]
    texts = [" ".join(words[at : at + 600]) for at in range(0, len(words), 600)]
    frequent = spark.createDataFrame([("en", w, 10) for w in words], "lang string, phrase string, n long")
    level = collocations.broadcastable(*collocations.coded(frequent, "words", ["lang", "phrase"], 100, 1 << 20), 1)
    held = {}
    for part in (texts[:1], texts[:5], texts):  # the first only warms up
        tracemalloc.start()
        held[len(part)] = sum(b.num_rows for b in counted(part)([level])), tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert [held[n][0] for n in (5, 40)] == [5 * 599, 40 * 599]
    assert held[40][1] < 2 * held[5][1]


def test_pairs_without_codes_are_sent_by_their_words(spark, monkeypatch):
    """All words have codes, most pairs have none: triples around those come by codes, and are whole."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 700)
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(12)], range(1, 13), k=60)) for _ in range(300)]
    docs = spark.createDataFrame([(lang, t) for t in texts for lang in ("en", "de")], "lang string, text string")
    whole, some = (collocations.phrase_counts(docs, 3, rows=n)[1] for n in (1 << 20, 30))
    for a, b in zip(whole, some, strict=True):
        assert a.count() and sorted(a.collect()) == sorted(b.collect())
    words, pairs = (level.withColumnRenamed("n", "_n").selectExpr("lang", "phrase", "_n n") for level in whole[:2])
    full, table_ = collocations.coded(words, "words", ["lang", "phrase"], 30, 1 << 20)
    first = collocations.broadcastable(full, table_, 1)
    code = {(r.lang, r.phrase): r.code for r in table_.collect()}
    parts = [(r.lang, *r.phrase.split(), r.phrase, r.n) for r in pairs.collect()]
    parts = spark.createDataFrame([(code[x, a], code[x, b], x, p, n) for x, a, b, p, n in parts], "left long, right long, lang string, phrase string, n long")
    second = collocations.broadcastable(*collocations.coded(parts, "pairs", ["left", "right"], 30, 1 << 20), 2)
    rows = [r for b in counted(texts)([first, second]) for r in b.to_pylist()]
    assert sum(r["n"] for r in rows) <= 300 * 58
    assert all(r["phrase"] is None for r in rows) and any(r["left"] < 0 for r in rows) and any(r["left"] >= 0 for r in rows)


def test_words_of_one_crc():
    words = pa.array([b"plumless", b"buckeroo", b"other", "\u00e9".encode()])
    found = collocations.Words.of(words, np.array([5, 0, 7, 2]))
    assert len(set(found.hashes)) == 3
    asked = pa.array([b"other", b"buckeroo", b"none", b"plumless", b"", "\u00e9".encode(), b"zzz"])
    assert found.find(asked, collocations.crc(asked)).tolist() == [7, 0, -1, 5, -1, 2, -1]
    one = collocations.Words.of(words[:1], np.array([3]))
    assert one.find(words, collocations.crc(words)).tolist() == [3, -1, -1, -1]


@pytest.mark.parametrize("length", [1, 2, 3])
def test_every_phrase_is_marked(spark, length):
    phrases = [" ".join(f"w{i * k % 997}" for k in range(1, length + 1)) for i in range(900)]
    rows = [(lang, p) for p in sorted(set(phrases)) for lang in ("en", "de")]
    frame = spark.createDataFrame(rows, "lang string, phrase string").repartition(5)
    level = collocations.Level(marks=collocations.marks_of(frame, length, len(rows)))
    hashes = {
        lang: collocations.phrase_hashes(collocations.word_hashes(lang, collocations.crc(pa.array([w.encode() for p in sorted(set(phrases)) for w in p.split()]))), length)
        for lang in ("en", "de", "fr")
    }
    assert level.marked(hashes["en"][::length]).all() and level.marked(hashes["de"][::length]).all()
    assert level.marked(hashes["fr"][::length]).mean() < 0.2


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_019
    one = spark.createDataFrame([("en", "a", 7 * big), ("en", "b", 5 * big)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("en", "a b", big)], one.schema)
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: (one.limit(1).select("lang", "n"), [one, two]))
    row = collocations.collocations(two, max_words=2).first()
    assert row.score == 10**6 * big * big // (35 * big * big)


def test_odd_rows(spark, odd_documents, no_documents):
    got = collocations.collocations(odd_documents)
    assert compare.rows_of(got.columns, got.collect()) == over(odd_documents.collect())
    assert collocations.collocations(no_documents).count() == 0


def test_all_kept_without_a_limit(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert collocations.collocations(docs, top=5).count() <= collocations.collocations(docs, top=None).count()
