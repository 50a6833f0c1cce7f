"""Vectors of several lengths."""

import numpy as np

from scoutlake.llm import embeddings


def test_vectors_of_every_length_are_compared(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size, n in ((16, 30), (8, 6), (3, 4)):
        for _ in range(n):
            x = rng.normal(size=size)
            rows += [(len(rows), x.tolist()), (len(rows) + 1, (x * 2 + rng.normal(size=size) * 0.001).tolist())]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    for i, v in rows:
        cosines = [(j, np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) for j, w in rows if j != i and len(w) == len(v)]
        assert got[i]["n_links"] == sum(c >= embeddings.COSINE for _, c in cosines) >= 1
        assert got[i]["component_id"] <= i - i % 2


def test_recall_of_planted_pairs(spark):
    rng = np.random.default_rng(11)
    n, size = 3000, 64
    a = rng.normal(size=(n, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=(n, size))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.96, n)[:, None]
    b = (a * cosine + side * np.sqrt(1 - cosine**2)) * rng.uniform(0.1, 9, (n, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[i + n]["component_id"] == i for i in range(n)) >= 0.99 * n
    assert sum(r["n_links"] for r in got.values()) == 2 * sum(got[i + n]["n_links"] for i in range(n))


def test_large_cluster_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=32)
    x = np.concatenate([centre + rng.normal(size=(400, 32)) * 0.15, rng.normal(size=(200, 32))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= embeddings.COSINE
    np.fill_diagonal(near, False)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[7].tolist()) for i in range(30)]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    want = near.sum(1) + 30 * near[:, 7]
    want[7] += 30
    assert abs(sum(got[i] for i in range(600)) - want.sum()) <= 0.002 * want.sum() and all(got[i] <= want[i] for i in range(600))
    assert {got[1000 + i] for i in range(30)} == {got[7]}
