import numpy as np
import pytest
from modelsift.llm import embeddings


def near(rng, n, dims):
    """Groups of vectors with cosines around 0.9, and strangers."""
    centres = rng.normal(size=(n // 4, dims))
    noise = rng.normal(size=(n // 4 * 3, dims)) * rng.choice([0.1, 0.25, 0.33, 0.4], size=(n // 4 * 3, 1))
    return np.concatenate([np.repeat(centres, 3, axis=0) + noise, rng.normal(size=(n // 4, dims))]).astype(np.float32)


def counts(x):
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = unit @ unit.T >= embeddings.COSINE
    np.fill_diagonal(hit, False)
    return hit.sum(axis=1)


@pytest.mark.parametrize("dims", [16, 32, 64, 96])
def test_recall_and_no_constant_table(spark, dims):
    x = near(np.random.default_rng(dims), 800, dims)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    found = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    expected = counts(x)
    assert all(found[i] <= n for i, n in enumerate(expected))
    assert sum(found.values()) >= 0.9 * expected.sum() > 100
    codes = embeddings.coder({dims: embeddings.learned_rotation(x.astype(np.float64))})
    import pyarrow as pa

    values = codes(pa.array(x.tolist(), pa.list_(pa.float32()))).to_numpy().view(np.uint64)
    for first, bits in embeddings._spans(embeddings.TABLES, min(dims, 64)):
        assert len(np.unique((values >> np.uint64(first)) & np.uint64((1 << bits) - 1))) > 1


def test_few_numbers_and_their_tables(spark):
    """Fewer numbers than tables: the empty substrings are no tables, and every pair is still found once."""
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [-1.0, 0.2]), (4, [5.0]), (5, [0.5]), (6, [-3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_double_precision(spark):
    rows = [(1, [1e300, 1.0]), (2, [1e300, 1.0]), (3, [1e-300, 1e-300]), (4, [1e-300, 1e-300]), (5, [-1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0}
    whole = spark.createDataFrame([(1, [3, 4]), (2, [6, 8])], "vec_id long, embedding array<int>")
    assert [r.n_links for r in embeddings.near_vectors(whole).collect()] == [1, 1]
