import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from modelsift.llm import bpe
from odd_rows import no_documents, odd_documents  # noqa: F401
from tokenizers import Tokenizer

from conftest import SMALL

PATH = public_tokenizers.path(bpe.FILE)
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.Vocabulary(open(PATH, encoding="utf-8").read())


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def ids(text):
    return np.frombuffer(OURS.encoded(text), "<u4").tolist()


TEXTS = [
    "",
    " \n\t\x1c\x85\xa0 ",
    "Hello World's I'LL we've 12²½",
    "<|endoftext|>a<|startoftext|><|endoftext|> <|ENDOFTEXT|> <|endoftext|",
    "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ é Å ǅ ẞ",
    "日本語 한국어 👩‍👩‍👧 ‍   x \U0001faf8",
    "a_b--c  d\x00e ՘࢏ \U000107bb",
    "don't stop'stop 'S ''re",
    "x" * 3000,
    "".join(chr(97 + i * i % 26) for i in range(5000)) + " é" * 9,
]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_as_the_library(text):
    assert ids(text) == expected(text)
    assert OURS.decoded(OURS.encoded(text)) == LIBRARY.decode(expected(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("aAß'st redmlv<|endofx>.1é", max_size=40))
def test_any_text_as_the_library(text):
    assert ids(text) == expected(text)


def test_every_usual_character_is_split_as_the_library_splits_it():
    usual = [c for c in map(chr, range(0x2100)) if bpe.UNUSUAL.search(c) is None]
    for c in usual:
        text = f"a{c}b{c}{c} 'S{c}1"
        assert ids(text) == expected(text), hex(ord(c))


def test_long_words_merge_in_the_same_order():
    rng = random.Random(3)
    for size in (1, 2, 3, 50, 400):
        parts = [OURS.inner[rng.choice(b"abcdeinotrs")] for _ in range(size)]
        assert bpe.merged(parts.copy(), OURS.merges) == bpe.merged_long(parts.copy(), OURS.merges)


def test_unknown_ids_and_other_files():
    assert OURS.decoded(np.array([320, 99_999, 320], "<u4").tobytes()) == "a</w> a</w>"
    with pytest.raises(ValueError):
        bpe.Vocabulary(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_odd_rows(spark, odd_documents, no_documents):
    clash = odd_documents.withColumnRenamed("extra", "ids").withColumnRenamed("key", "decoded")
    rows = bpe.decoded(bpe.encoded(clash, PATH), PATH)
    assert sorted(rows.columns) == sorted(clash.columns + ["n_tokens"])
    found = sorted((r.doc_id or 0, r.text or "", r.ids, r.n_tokens, r.decoded) for r in rows.collect())
    want = []
    for r in odd_documents.collect():
        e = expected(r.text or "")
        want.append((r.doc_id or 0, r.text or "", np.array(e, "<u4").tobytes(), len(e), LIBRARY.decode(e, skip_special_tokens=False)))
    assert [(a, b, bytes(c), d, e) for a, b, c, d, e in found] == sorted(want)
    assert bpe.decoded(bpe.encoded(no_documents, PATH), PATH).count() == 0


def test_query_against_the_library(spark):
    found = {r.doc_id: r for r in bpe.op12_rank_array_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        e = expected(d.text or "")
        r = found[d.doc_id]
        assert r.n_tokens == len(e)
        assert r.ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(e, skip_special_tokens=False).encode()).hexdigest()
