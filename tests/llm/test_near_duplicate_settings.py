import random
import re

import pytest

import corpus_pipeline
from conftest import SMALL
from modelsift.llm import minhash
from test_near_duplicates import Groups


def survivors(rows, width, percent):
    """The smallest id of each group, by comparing all pairs."""
    sets, groups = {}, Groups()
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        cut = set(zip(*[w[i:] for i in range(width)], strict=False))
        sets[doc_id] = cut if len(w) >= width else {tuple(w)} if w else set()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                groups.join(a, b)
    return sorted(i for i in ids if groups.find(i) == i)


def test_stage_takes_width_and_percent(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for size in (1, 4, 5, 60, 300, 1000):
        base = [word() for _ in range(size)]
        for grown in (0, 0.2, 0.22, 0.3):  # a passage appended
            rows.append((len(rows), " ".join(base + [word() for _ in range(int(size * grown))])))
        copy = base.copy()
        for at in range(0, size, 25):  # scattered edits
            copy[at] = word()
        rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {}
    for width, percent in ((3, 85), (5, 80)):
        stage = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL, width, percent)
        kept[width] = sorted(r.doc_id for r in stage.collect())
        assert kept[width] == survivors(rows, width, percent)
    assert kept[3] != kept[5]


def test_bands_follow_the_percent():
    assert minhash.bands_of(85) == 32
    assert (1 - 0.8**minhash.ROWS) ** minhash.bands_of(80) <= minhash.MISSED
    assert minhash.most_odd_bits(0.80) > minhash.most_odd_bits()
    with pytest.raises(ValueError):
        minhash.bands_of(50)
