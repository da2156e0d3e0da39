import random
import re

import numpy as np

from modelsift.llm import embeddings, minhash
from modelsift.llm.common import components
from odd_rows import no_documents, odd_documents  # noqa: F401


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_components(rows):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[doc_id] = set(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else {tuple(w)} if w else set()
    groups, ids = Groups(), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 400).selectExpr("id as a", "id + 1 as b").unionByName(spark.sql("select 900L a, 901L b"))
    got = {r.id: r.component for r in components(edges, "chain").collect()}
    assert got == {**dict.fromkeys(range(1, 401), 1), 900: 900, 901: 900}


def test_near_copies_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(1, 150))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = base.copy()
            for _ in range(rng.randint(0, max(0, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            text = " ".join(copy)
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_near_copies_on_odd_rows(spark, odd_documents, no_documents):
    rows = minhash.near_duplicates(odd_documents.filter("doc_id <> 11 or doc_id is null")).collect()
    got = {r.doc_id: r for r in rows}
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 1, 1, 4, 5, 6, 7, 8]
    assert got[4].n_shingles == got[5].n_shingles == 0 and got[7].n_shingles == got[8].n_shingles == 1
    assert got[None].component_id is None and got[None].kept
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert minhash.near_duplicates(no_documents).count() == 0


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = a.copy()
    b[:40] += np.uint64(1)  # similarity 960 / 1040
    m = minhash._multipliers()
    odd = int(np.unpackbits((minhash.odd_sketch(minhash.samples(a, m)) ^ minhash.odd_sketch(minhash.samples(b, m))).view(np.uint8)).sum())
    estimate = 1 + minhash.SKETCH_BITS / (4 * minhash.SAMPLES) * np.log(1 - 2 * odd / minhash.SKETCH_BITS)
    assert abs(estimate - 960 / 1040) < 0.06 and odd <= minhash.most_odd_bits()


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        centre = rng.normal(size=32)
        for _ in range(rng.integers(1, 30)):
            rows.append((len(rows), (centre + rng.normal(size=32) * rng.choice([0.05, 0.1, 0.2])).astype("f4").tolist()))
    n = len(rows)
    odd = [
        (n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] * 32), (n + 3, [float("inf")] + [1.0] * 31),
        (n + 4, [None] + [1.0] * 31), (n + 5, []), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (None, rows[0][1]), rows[0],
    ]
    vectors = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_vectors(vectors, block=64).collect()}
    assert len(got) == n + 9
    v = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    links = v @ v.T >= 0.9
    np.fill_diagonal(links, False)
    found = sum(got[i].n_links for i in range(n))
    assert 0.9 * links.sum() <= found <= links.sum()
    assert all(got[i].n_links <= links[i].sum() for i in range(n))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(n, n + 6))
    assert got[n + 6].n_links == got[n + 7].n_links == 1 and got[n + 7].component_id == n + 6
    assert got[None].n_links == 0
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embeddings.near_vectors(empty).count() == 0
